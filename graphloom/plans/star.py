"""The test tables as a property graph, as files, and as symbols, so that every operator has rows to work on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import words
from graphloom.operators.edges import deduplicated, ordered
from graphloom.operators.settle import forget_at_exit, shared_dir
from graphloom.operators.snapshot import Store
from graphloom.operators.text import postings, statistics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, c: str):
    return F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, target_key, relation, confidence) with repeated edges."""
    t = lambda name: table(spark, sf_dir, name)
    e = lambda df, s, g, relation, c: df.select(s.alias("source_key"), g.alias("target_key"), F.lit(relation).alias("relation"), c.cast("double").alias("confidence"))
    line = t("lineitem")
    called = F.when(F.col("o_orderstatus") == "F", 0.95).when(F.col("o_orderstatus") == "O", 0.90).otherwise(0.85)
    bought = F.when(F.col("l_returnflag") == "R", 0.95).when(F.col("l_returnflag") == "A", 0.90).otherwise(0.75)
    stocked = F.when(F.col("l_linestatus") == "F", 0.90).otherwise(0.55)
    return (
        e(t("nation"), _key("region", "n_regionkey"), _key("nation", "n_nationkey"), "CONTAINS", F.lit(1.0))
        .union(e(t("customer"), _key("nation", "c_nationkey"), _key("customer", "c_custkey"), "IMPORTS", F.lit(1.0)))
        .union(e(t("orders"), _key("customer", "o_custkey"), _key("orders", "o_orderkey"), "CALLS", called))
        .union(e(line, _key("orders", "l_orderkey"), _key("part", "l_partkey"), "CALLS", bought))
        .union(e(line, _key("part", "l_partkey"), _key("supplier", "l_suppkey"), "REFERENCES", stocked))
        .union(e(t("supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "INHERITS", F.lit(0.95)))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(raw_edges(spark, sf_dir))


_published: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, what: str, tables) -> Store:
    """A published snapshot of the folder: built by the first query of an application that asks, read by others."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _published:
        root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        forget_at_exit(spark, root)
        Store(spark, root).publish(tables())
        _published[key] = root
    return Store(spark, _published[key])


def published(spark: SparkSession, sf_dir: str, end: str = "source_key") -> DataFrame:
    """The edges of the folder's published snapshot, in the order of one of their ends."""

    def tables() -> dict[str, DataFrame]:
        e = edges(spark, sf_dir)
        return {f"edges_{k}": ordered(e, k) for k in ("source_key", "target_key")}

    return _store(spark, sf_dir, "graph", tables).table(f"edges_{end}")


def words_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc_id, lang, dl, tf) and statistics of the folder's documents, published."""
    units = table(spark, sf_dir, "documents").select("doc_id", "lang", words("text").alias("terms"))
    store = _store(spark, sf_dir, "words", lambda: {"postings": postings(units, ["doc_id"], "terms", ("lang",)), "statistics": statistics(units, "terms")})
    return store.table("postings"), store.table("statistics")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_key, name, kind)"""
    out = None
    for kind, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority")):
        part = table(spark, sf_dir, kind).select(_key(kind, key).alias("node_key"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: brands are their files."""
    return table(spark, sf_dir, "part").select(
        _key("part", "p_partkey").alias("node_key"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.lit("Function").alias("kind"),
        F.concat_ws("/", F.lit("src"), "p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path of the URL."""
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[^:]*://(.*)$", 1).alias("path"), F.when(F.col("page_id") % 3 == 0, "test").otherwise("source").alias("kind"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("lang") == "en", "doc").otherwise("source").alias("scope"), "text", "doc_id", "source")
