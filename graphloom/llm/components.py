"""Connected components of an edge table: a forest in each task, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch


#: Nodes that a task ties together before it hands their edges on.
HOLD = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's edges tie together, as edges to the smallest node of each part."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def rows() -> pa.RecordBatch:
        tied = [(x, root(x)) for x in up]
        tied = [p for p in tied if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in tied], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > HOLD:
            yield rows()
            up.clear()
    yield rows()


def _least(e: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, m): each node's smallest neighbour. A table of its own, so that the join with it may split a hub's edges."""
    return scratch.save(e.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are tied to its smallest neighbour (itself included)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both, scratch)
    tied = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return tied.where("u <> v").distinct(), low


def _small(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours are tied to the smallest of them; edges come as u > v."""
    low = _least(e, scratch)
    tied = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
    return tied.distinct(), low


def _stars(e: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, on which nothing but nodes like itself hang."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").count() == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Duplicate edges and loops are allowed; nodes without an edge to another node are not returned.
    Every step is a hash aggregate with partial sums and an equi-join that AQE may split, so a hub with a
    third of all edges is no bottleneck; each round is written to the shared folder and the number of rounds
    is logarithmic in the longest path. A forest of stars is the end.
    """
    e = edges.where("u <> v").select("u", "v").mapInArrow(_forest, "u long, v long").distinct()
    e = scratch.save(e, "edges")
    while not _stars(e):
        for step in (_large, _small):
            new, low = step(e, scratch)
            new = scratch.save(new, "edges")
            scratch.drop(e, low)
            e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
