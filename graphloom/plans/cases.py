"""Queries that give every row of a table one of several spelled-out inputs, beside DuckDB's SQL of the known results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.catalogue import ORACLES, QUERIES
from graphloom.plans.star import table

#: In inputs and results this stands for the row's key.
KEY = "{k}"


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def spelled(spark: SparkSession, sf_dir: str, name: str, key: str, inputs: str, rows: list[tuple]) -> DataFrame:
    """(k, i, inputs): every row of a table with the input whose number is its key modulo their number."""
    names = [x.split()[0] for x in inputs.split(", ")]
    t = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("k"), F.pmod(F.col(key), F.lit(len(rows))).cast("int").alias("i"))
    told = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {inputs}")
    out = t.join(F.broadcast(told), "i")
    kinds = dict(told.dtypes)
    return out.select("k", "i", *[F.replace(c, F.lit(KEY), F.col("k").cast("string")).alias(c) if kinds[c] == "string" else F.col(c) for c in names])


def known(name: str, key: str, outputs: str, rows: list[tuple]) -> str:
    """The SQL of the results, a tuple an input; outputs are (name type) in SQL types."""
    cols = [x.split() for x in outputs.split(", ")]
    values = ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(rows))
    shown = [f"replace(t.{c}::VARCHAR, '{KEY}', {key}::VARCHAR) AS {c}" if kind == "VARCHAR" else f"t.{c}::{kind} AS {c}" for c, kind in cols]
    return f"SELECT {key}::BIGINT AS k, {', '.join(shown)} FROM {name} JOIN (VALUES {values}) t(i, {', '.join(c for c, _ in cols)}) ON {key} % {len(rows)} = t.i"


def cases(name: str, key: str, inputs: str, outputs: str, rows: list[tuple[tuple, tuple]]):
    """Registers f(df with k and inputs) -> df with k and outputs, over pairs of an input and its result."""

    def add(f: Callable[[DataFrame], DataFrame]):
        names = [x.split()[0] for x in outputs.split(", ")]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spelled(spark, sf_dir, name, key, inputs, [r[0] for r in rows])).select("k", *names)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = known(name, key, outputs, [r[1] for r in rows])
        return run

    return add


def by_row(f: Callable[..., object], inputs: list[str], output: str, kind: str = "string"):
    """A column of f over the values of columns, in Arrow batches."""

    @F.udf(kind, useArrow=True)
    def column(*values):
        return f(*values)

    return column(*[F.col(c) for c in inputs]).alias(output)
