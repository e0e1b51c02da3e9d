"""Vectors: validation, cosine top-k, reciprocal-rank fusion, fallbacks, helper order (VC-1 to VC-9, JN-12, JN-16, WN-1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import byte_prefix

#: The constant of rank fusion, results of a list, bytes and chunks that are embedded at most.
FUSION, TOP, INPUT_BYTES, MOST_CHUNKS = 60, 200, 6144, 4096
#: Items that a helper is shown at most.
HELPED = 20


def doubles(v: str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def valid(v: str, size: int) -> Column:
    """Right size, finite, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & fine & (norm(v) > 0), F.lit(False))


def normalised(vectors: DataFrame, v: str, size: int) -> DataFrame:
    """Unit vectors of double; a row that is not valid raises."""
    ok = F.when(valid(v, size), F.transform(doubles(v), lambda x: x / norm(v))).otherwise(F.raise_error(F.lit("vector of another size, not finite, or zero")))
    return vectors.withColumn(v, ok)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_top(vectors: DataFrame, key: str, v: str, query: DataFrame, size: int, top: int = TOP) -> DataFrame:
    """(key, score): the nearest to one query row, best first, keys breaking ties; the query travels, not the vectors.

    A query of more than one row is an error.
    """
    if query.limit(2).count() > 1:
        raise ValueError("one query row at a time")
    q = normalised(query.select(F.col(v).alias("__q")), "__q", size)
    return normalised(vectors.select(key, v), v, size).crossJoin(F.broadcast(q)).select(key, dot(v, "__q").alias("score")).orderBy(F.col("score").desc(), key).limit(top)


def fused(lists: dict[str, DataFrame], key: str, top: int = TOP, k: int = FUSION) -> DataFrame:
    """(key, score, reason) of ranked lists (key, score): the sum of 1 / (k + rank); the lists that name a key are its reason."""
    ranked = [df.select(key, F.lit(name).alias("source"), F.row_number().over(W.orderBy(F.col("score").desc(), key)).alias("rank")) for name, df in sorted(lists.items())]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.union(r)
    out = both.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_list("source")), "+").alias("reason"))
    return out.orderBy(F.round("score", 12).desc(), key).limit(top)


def fresh(vectors: DataFrame, current: DataFrame, key: list[str]) -> bool:
    """JN-16: whether every stored vector's chunk is still a current one; if not, a query falls back to words alone."""
    return vectors.join(current.select(*key), key, "left_anti").isEmpty()


def to_embed(chunks: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """VC-3: chunks whose key has no stored vector."""
    return chunks.join(stored.select(key), key, "left_anti")


def inputs(chunks: DataFrame, scopes: tuple[str, ...] = ("source", "doc")) -> DataFrame:
    """VC-2: what is embedded of chunks (path, scope, start_line, end_line, heading, body): a text and its digest as the key.

    More chunks than MOST_CHUNKS are an error of the caller, who decides what is left out; nothing is dropped here.
    """
    text = byte_prefix(F.concat_ws("\n", "path", F.expr("nullif(heading, '')"), "body"), F.lit(INPUT_BYTES))
    return chunks.where(F.col("scope").isin(*scopes)).withColumn("input", text).withColumn("key", F.sha2(F.col("input").cast("binary"), 256))


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], size: int) -> DataFrame:
    """VC-8: (key, vector) of inputs (key, input); load() is called once a Python worker and gives the encoder.

    Vectors of another size, not finite or zero raise.
    """

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for part in parts:
            if len(part):
                encode = encode or load()
                yield pd.DataFrame({"key": part["key"], "vector": encode(part["input"].tolist())})

    return normalised(rows.select("key", "input").mapInPandas(fn, "key string, vector array<double>"), "vector", size)


def refreshed(chunks: DataFrame, stored: DataFrame | None, load: Callable, size: int) -> DataFrame:
    """VC-3: vectors of the chunks; those whose key is stored are taken from there, the rest is embedded."""
    if stored is None:
        return embedded(chunks, load, size)
    kept = stored.join(chunks.select("key"), "key", "left_semi")
    return kept.unionByName(embedded(to_embed(chunks, stored, "key"), load, size))


def keyed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """JN-12: chunks with the vectors of their keys; chunks of equal inputs share one."""
    return chunks.join(vectors.select("key", "vector"), "key")


def semantic_state(stored: dict | None, wanted: dict, vectors: DataFrame | None, current: DataFrame, key: list[str]) -> str:
    """VC-6: disabled, corrupt, busy, stale or ready, of a store's metadata and vectors against what is wanted."""
    if stored is None or vectors is None:
        return "disabled"
    if stored.get("building"):
        return "busy"
    if any(stored.get(k) != v for k, v in wanted.items()):
        return "stale"
    if not vectors.where(~F.coalesce(valid("vector", wanted["size"]), F.lit(False))).isEmpty():
        return "corrupt"
    return "ready" if fresh(vectors, current, key) else "stale"


def ranked(state: str, semantic: Callable[[], DataFrame], lexical: DataFrame, key: str, top: int = TOP) -> tuple[DataFrame, str]:
    """VC-6: lists fused where vectors are ready; otherwise words alone in their own order, and why."""
    if state != "ready":
        return lexical.select(key, "score", F.lit("lexical").alias("reason")).orderBy(F.col("score").desc(), key).limit(top), state
    return fused({"semantic": semantic(), "lexical": lexical}, key, top), state


def helper_order(items: DataFrame, choose: Callable[[list[str]], object], describe: Column, most: int = HELPED) -> tuple[DataFrame, str]:
    """VC-9: items (place, reason) in a helper's order, with a new place: exact ones, then the chosen, then the others.

    choose() is told the first `most` items that are not exact, as texts, and answers with their numbers. An answer that
    is no list of distinct numbers of theirs, or an error, leaves the order as it is.
    """
    shown = items.where("reason <> 'exact'").orderBy("place").limit(most).select("place", describe.alias("text")).collect()
    try:
        ids = choose([r["text"] for r in shown])
        fine = isinstance(ids, list) and 0 < len(ids) <= len(shown) and all(type(i) is int and 0 <= i < len(shown) for i in ids) and len(set(ids)) == len(ids)
    except (OSError, ValueError, TypeError, KeyError):
        fine = False
    first = {shown[i]["place"]: k for k, i in enumerate(ids)} if fine else {}
    rank = F.lit(len(first))
    for place, k in first.items():
        rank = F.when(F.col("place") == place, k).otherwise(rank)
    order = F.struct((F.col("reason") != "exact").alias("late"), F.when(F.col("reason") == "exact", -1).otherwise(rank).alias("rank"), F.col("place").alias("at"))
    return items.withColumn("place", F.row_number().over(W.orderBy(order))), "ready" if fine else "fallback"
