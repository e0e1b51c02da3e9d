"""Edges: tiers, deduplication, upserts, differences, export (RES-17/18, SNK-3/4/5, AG-1, FLT-8/9/13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers by confidence, those that are only candidates, and the relations.
TIERS = {0.95: "import_map", 0.90: "same_module", 0.85: "inherited", 0.75: "unique_name", 0.60: "inherited_uncertain", 0.55: "suffix", 0.35: "fuzzy"}
CANDIDATES = ("unique_name", "inherited_uncertain", "suffix", "fuzzy")
RELATIONS = ("IMPORTS", "CALLS", "INHERITS", "REFERENCES")
KEY = ["source_key", "target_key", "relation"]


def tier(relation: Column, confidence: Column) -> Column:
    out = F.lit("unknown")
    for c, name in TIERS.items():
        out = F.when(F.round(confidence, 2) == c, name).otherwise(out)
    return F.when(relation.isin("IMPORTS", "CONTAINS", "DEFINES"), "path").otherwise(out)


def status(tier_: Column) -> Column:
    return F.when(tier_.isin(*CANDIDATES), "candidate").otherwise("resolved")


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge a (source, target, relation) with the largest confidence, and the tier and status that it means."""
    best = edges.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    best = best.withColumn("resolution_tier", tier(F.col("relation"), F.col("confidence")))
    return best.withColumn("resolution_status", status(F.col("resolution_tier")))


def chosen(edges: DataFrame, relations: tuple[str, ...] | None = None, candidates: bool = False) -> DataFrame:
    """Edges of the relations; candidate ones only if asked for."""
    out = edges if candidates else edges.where("resolution_status = 'resolved'")
    return out.where(F.col("relation").isin(*relations)) if relations else out


def counts(edges: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(relation, n) with 0 for a relation without edges."""
    names = edges.sparkSession.createDataFrame([(r,) for r in relations], "relation string")
    n = edges.groupBy("relation").agg(F.count("*").alias("n"))
    return names.join(n, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def difference(old: DataFrame, new: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots, nulls being equal."""
    a = old.select(*key, F.struct(*payload).alias("__old"))
    b = new.select(*key, F.struct(*payload).alias("__new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "change")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have; a snapshot is rewritten, never updated in place."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints are both nodes (node_key)."""
    keys = nodes.select("node_key")
    out = edges.join(keys.withColumnRenamed("node_key", "source_key"), "source_key", "left_semi")
    return out.join(keys.withColumnRenamed("node_key", "target_key"), "target_key", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an endpoint is no node (JN-17)."""
    keys = nodes.select("node_key")
    lost = [edges.join(keys.withColumnRenamed("node_key", c), c, "left_anti").select(*KEY) for c in ("source_key", "target_key")]
    return lost[0].union(lost[1]).distinct()


def ordered(edges: DataFrame, end: str) -> DataFrame:
    """Edges in ranges of one of their ends, as a snapshot keeps them for walks from that end."""
    return edges.repartitionByRange(end).sortWithinPartitions(end)
