"""Graph operators: bounded reach, shortest paths, impact (GR-1 to GR-13).

Frontiers are DataFrames: each hop joins the frontier with the edges, drops what was seen, and keeps one row a
(target, node). A hop is checkpointed in the shared folder, so plans stay as short as one hop. The keys of a frontier
of few rows reach the scan, so edges that are kept in the order of the end that is walked from are read in part.
"""

from __future__ import annotations

import math
import time
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.edges import chosen
from graphloom.operators.settle import met, narrow, settle

MAX_DEPTH, PATH_SEP = 5, " > "
#: Limits of work of a question.
MOST_NODES, MOST_EDGES, SECONDS = 2000, 10_000, 2.0
#: Starts of a block and ends held beside them, rows of a task and tasks of what three hops join.
BLOCK, HELD, TASK_ROWS, MOST_TASKS = 2000, 10_000, 4_000_000, 2000


def _steps(edges: DataFrame, incoming: bool) -> DataFrame:
    """(at, to, relation, confidence, candidate) along or against the edges."""
    a, b = ("target_key", "source_key") if incoming else ("source_key", "target_key")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "relation", "confidence", (F.col("resolution_status") == "candidate").alias("candidate"))


class Work(NamedTuple):
    """An answer within its limits of work, or none and the limit that it met (GR-15)."""

    frame: DataFrame | None
    reason: str | None


def limited(edges: DataFrame, targets: DataFrame, depth: int, incoming: bool = True, relations: tuple[str, ...] | None = None, candidates: bool = False, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES, seconds: float = SECONDS) -> Work:
    """reach() hop by hop; before each the edges that it would walk are counted up to the limit, and nodes after it.

    Time is looked at between hops, so a hop that has begun ends.
    """
    end, seen, walked = time.monotonic() + seconds, targets.select(F.col("node_key").alias("at")).distinct(), 0
    steps = _steps(chosen(edges, relations, candidates), incoming)
    for hop in range(1, min(MAX_DEPTH, max(1, depth)) + 1):
        walked = steps.join(seen, "at", "left_semi").limit(most_edges + 1).count()
        if walked > most_edges:
            return Work(None, "edges")
        found = reach(edges, targets, hop, incoming, relations, candidates)
        if found.limit(most_nodes + 1).count() > most_nodes:
            return Work(None, "nodes")
        if time.monotonic() > end and hop < depth:
            return Work(None, "time")
        seen = targets.select(F.col("node_key").alias("at")).union(found.select("node_key")).distinct()
    return Work(found, None)


def reach(edges: DataFrame, targets: DataFrame, depth: int, incoming: bool = True, relations: tuple[str, ...] | None = None, candidates: bool = False) -> DataFrame:
    """Nodes within depth (1 to 5) of each target (`of`), without the target itself.

    distance is the shortest; confidence the largest product of the walks of that length, and status that of the
    best of them (resolved before candidate on a tie); relations are all that lead into the node in that hop.
    """
    depth = min(MAX_DEPTH, max(1, depth))
    steps = _steps(chosen(edges, relations, candidates), incoming)
    front = targets.select(F.col("node_key").alias("of"), F.col("node_key").alias("node"), F.lit(1.0).alias("confidence"), F.lit(False).alias("candidate")).distinct()
    front = settle(front)
    seen, layers = front.select("of", "node"), []
    for distance in range(1, depth + 1):
        front, near = met(front, "node", steps, "at")
        walk = front.alias("f").join(near.alias("s"), F.col("f.node") == F.col("s.at"))
        walk = walk.select("of", F.col("s.to").alias("node"), (F.col("f.confidence") * F.col("s.confidence")).alias("confidence"), (F.col("f.candidate") | F.col("s.candidate")).alias("candidate"), "relation")
        walk = walk.join(seen, ["of", "node"], "left_anti")
        layer = walk.groupBy("of", "node").agg(F.max(F.struct("confidence", (~F.col("candidate")).alias("sure"))).alias("best"), F.array_sort(F.collect_set("relation")).alias("relations"))
        layer = settle(layer.select("of", "node", F.lit(distance).alias("distance"), F.col("best.confidence").alias("confidence"), (~F.col("best.sure")).alias("candidate"), "relations"))
        layers.append(layer)
        seen = seen.union(layer.select("of", "node"))
        front = layer.select("of", "node", "confidence", "candidate")
    out = layers[0]
    for layer in layers[1:]:
        out = out.union(layer)
    state = F.when(F.col("candidate"), "candidate").otherwise("resolved")
    return out.select("of", F.col("node").alias("node_key"), "distance", "confidence", "relations", state.alias("resolution_status"))


def parallel(edges: DataFrame, relations: tuple[str, ...] | None = None, candidates: bool = False) -> DataFrame:
    """GR-4: one edge a (source, target): the best confidence, its weight 1 / max(confidence, 0.01), all relations."""
    out = chosen(edges, relations, candidates).groupBy("source_key", "target_key").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("relation")).alias("relations"))
    return out.withColumn("weight", 1 / F.greatest("confidence", F.lit(0.01)))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int, relations: tuple[str, ...] | None = None, candidates: bool = False) -> DataFrame:
    """(node_key, cost, hops, path): the cheapest path of at most max_hops from any source.

    Relaxation by rounds: a round extends what the last one improved. Ties go to the smaller path text. A source
    itself has cost 0 and no hops.
    """
    steps = parallel(edges, relations, candidates).select(F.col("source_key").alias("at"), F.col("target_key").alias("to"), "weight")
    best = settle(sources.select("node_key", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.col("node_key").alias("path")).distinct())
    front = best
    for hop in range(1, max_hops + 1):
        front, near = met(front, "node_key", steps, "at")
        new = front.join(near, F.col("node_key") == F.col("at")).select(F.col("to").alias("node_key"), (F.col("cost") + F.col("weight")).alias("cost"), F.lit(hop).alias("hops"), F.concat_ws(PATH_SEP, "path", "to").alias("path"))
        merged = best.union(new).groupBy("node_key").agg(F.min(F.struct(F.round("cost", 9).alias("key"), "path", "cost", "hops")).alias("m"))
        merged = settle(merged.select("node_key", "m.cost", "m.hops", "m.path"))
        front = merged.where(F.col("hops") == hop)
        best = merged
        if front.isEmpty():
            break
    return best


def trace(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 4, relations: tuple[str, ...] | None = None, candidates: bool = False) -> DataFrame:
    """One row: the cheapest path from any source to any target, or a null path with the reason (GR-6/7)."""
    found = shortest_paths(edges, sources, max_hops, relations, candidates).join(targets.select("node_key"), "node_key", "left_semi")
    best = found.orderBy(F.round("cost", 9), "node_key", "path").limit(1).select("path", "hops", F.round("cost", 4).alias("cost"), F.lit(None).cast("string").alias("reason"))
    none = edges.sparkSession.createDataFrame([(None, None, None, "no path")], "path string, hops int, cost double, reason string")
    return best.union(none.join(best.select(F.lit(1).alias("x")), F.lit(True), "left_anti"))


def all_cheapest(edges: DataFrame, source: str, target: str, max_hops: int = 4, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Every path of least cost (to nine places) from source to target: walks along edges that keep to the least cost (GR-12)."""
    spark = edges.sparkSession
    dist = shortest_paths(edges, spark.createDataFrame([(source,)], "node_key string"), max_hops, relations).select("node_key", "cost")
    steps = parallel(edges, relations).select(F.col("source_key").alias("at"), F.col("target_key").alias("to"), "weight")
    tight = steps.join(dist.select(F.col("node_key").alias("at"), F.col("cost").alias("a")), "at").join(dist.select(F.col("node_key").alias("to"), F.col("cost").alias("b")), "to")
    tight = settle(tight.where(F.round(F.col("a") + F.col("weight"), 9) == F.round("b", 9)).select("at", "to"))
    # backwards from the target, so only paths that arrive are carried
    front = spark.createDataFrame([(target, target)], "node string, path string")
    done = []
    for _ in range(max_hops + 1):
        done.append(front.where(F.col("node") == source))
        front = settle(front.where(F.col("node") != source).join(tight, F.col("node") == F.col("to")).select(F.col("at").alias("node"), F.concat_ws(PATH_SEP, "at", "path").alias("path")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("path")


def impact(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int, incoming: bool = True, relations: tuple[str, ...] | None = None, scopes: tuple[str, ...] | None = None) -> DataFrame:
    """GR-8: nodes that a change of a seed reaches, with the first found path as evidence.

    Walks resolved edges through every node; scopes (kinds of the nodes) only choose what is returned. Of the paths
    of a node's least distance the smallest text is the evidence.
    """
    steps = _steps(chosen(edges, relations), incoming)
    front = seeds.select(F.col("node_key").alias("seed"), F.col("node_key").alias("node"), F.col("node_key").alias("evidence"), F.lit("").alias("hop_relations")).distinct()
    front = settle(front)
    seen, layers = front.select("seed", "node"), []
    for distance in range(1, min(MAX_DEPTH, max(1, depth)) + 1):
        front, near = met(front, "node", steps, "at")
        walk = front.join(near, F.col("node") == F.col("at")).select("seed", F.col("to").alias("node"), F.concat_ws(PATH_SEP, "evidence", "to").alias("evidence"), F.concat_ws(",", F.expr("nullif(hop_relations, '')"), "relation").alias("hop_relations"))
        walk = walk.join(seen, ["seed", "node"], "left_anti")
        layer = settle(walk.groupBy("seed", "node").agg(F.min(F.struct("evidence", "hop_relations")).alias("m")).select("seed", "node", "m.evidence", "m.hop_relations"))
        layers.append(layer.withColumn("distance", F.lit(distance)))
        seen, front = seen.union(layer.select("seed", "node")), layer
    out = layers[0]
    for layer in layers[1:]:
        out = out.union(layer)
    out = out.join(nodes.select(F.col("node_key").alias("node"), "kind"), "node", "left")
    if scopes:
        out = out.where(F.col("kind").isin(*scopes))
    return out.select("seed", F.col("node").alias("node_key"), "kind", "distance", "evidence", "hop_relations")


def neighbourhood(edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """GR-11: each seed's relationships either way, the first `most` in order, and whether there are more."""
    s = seeds.select(F.col("node_key").alias("seed"))
    out = s.join(edges, F.col("seed") == F.col("source_key")).select("seed", F.lit("outgoing").alias("direction"), F.col("target_key").alias("node_key"), "relation", "confidence")
    into = s.join(edges, F.col("seed") == F.col("target_key")).select("seed", F.lit("incoming").alias("direction"), F.col("source_key").alias("node_key"), "relation", "confidence")
    w = W.partitionBy("seed").orderBy("direction", F.col("confidence").desc(), "node_key", "relation")
    return out.union(into).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most + 1).withColumn("truncated", F.max("place").over(W.partitionBy("seed")) > most).where(F.col("place") <= most)


def chains(edges: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """GR-13: (source, target, path) of pairs whose distance is exactly three hops with a single path of that length.

    Paths are counted where their second hop ends, before the third one multiplies them: a node with one edge into it
    is reached by the paths to where that edge starts, so neither its own paths nor shorter ones need be looked for.
    Only nodes with several edges into them have their pairs gathered, where paths lead to them. Starts and ends of a node
    are dealt into blocks, so a crowded node is no single task. A start's rows follow each other by their ends, so a
    written table keeps little more of a path than where it differs from the one before.
    """
    e = settle(chosen(edges, relations).select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).where("a <> b").distinct())
    into = e.groupBy("b").agg((F.count("*") == 1).alias("sole"))
    last = settle(e.join(into, "b").select(F.col("a").alias("n"), "b", "sole"))
    onward = e.select("a").distinct()
    step = e.join(onward.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("a").alias("m"), F.col("b").alias("n"))
    two = e.withColumnRenamed("b", "m").join(step, "m").where("a <> n")
    two = two.groupBy("a", "n").agg(F.count("*").alias("k"), F.min("m").alias("m"), F.max("m").alias("z"))
    two = settle(two.join(e.withColumnRenamed("b", "n"), ["a", "n"], "left_anti"))  # what lies behind a direct edge is nearer than three hops

    sole, several = last.where("sole").drop("sole"), last.where("NOT sole").drop("sole")
    starts = two.where("k = 1").select("a", "m", "n")
    deal = settle(starts.groupBy("n").agg(F.count("*").alias("k")).join(sole.groupBy("n").agg(F.count("*").alias("ends")), "n").select("n", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("ends") / HELD).cast("int").alias("parts"), (F.col("k") * F.col("ends")).alias("rows")))
    tasks = math.ceil((deal.agg(F.sum("rows")).first()[0] or 0) / TASK_ROWS)
    tasks = min(MOST_TASKS, max(1, tasks))
    deal, on = narrow(deal.drop("rows")), ["n", "block", "part"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    ends = sole.join(deal, "n").select("n", "b", one_of("b", "parts").alias("part"), every("blocks").alias("block")).repartition(tasks, *on).sortWithinPartitions(*on, "b")
    starts = starts.join(deal, "n").select("n", "a", "m", one_of("a", "blocks").alias("block"), every("parts").alias("part")).repartition(tasks, *on)
    starts = starts.select(*on, "a", F.concat_ws(PATH_SEP, "a", "m", "n").alias("head"))
    one = starts.hint("merge").join(ends, on).where("a <> b")  # a part of the ends is held, starts pass by
    one = one.select(F.col("a").alias("source_key"), F.col("b").alias("target_key"), F.concat("head", F.lit(PATH_SEP), "b").alias("path"))

    ahead = settle(several.join(narrow(settle(two.select("n").distinct())), "n", "left_semi"))
    if ahead.isEmpty():
        return one
    # paths that come back to their end are none, so of two one may remain; of more at least two do
    back = lambda c: (F.col(c) == F.col("b")).cast("int")
    met_ = two.join(narrow(ahead), "n").where("a <> b").withColumn("paths", F.when(F.col("k") > 2, 2).otherwise(F.col("k") - back("m") - F.when(F.col("k") == 2, back("z")).otherwise(0)))
    mid = F.when(F.col("m") == F.col("b"), F.col("z")).otherwise(F.col("m"))
    rest = met_.where("paths > 0").groupBy("a", "b").agg(F.sum("paths").alias("paths"), F.min(F.struct(mid.alias("m"), "n")).alias("p")).where("paths = 1")
    nearer = e.withColumnRenamed("b", "n").join(several.join(narrow(settle(ahead.select("b").distinct())), "b", "left_semi"), "n").select("a", "b")
    rest = rest.join(e, ["a", "b"], "left_anti").join(nearer, ["a", "b"], "left_anti")
    return one.union(rest.select("a", "b", F.concat_ws(PATH_SEP, "a", "p.m", "p.n", "b")))
