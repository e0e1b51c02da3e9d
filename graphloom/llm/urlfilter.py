"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a canonical host and path prefix (`example.net/en/`). An entry fits its host and every subdomain if
the URL's path starts with its path. For each URL the host's suffixes of no more labels than the deepest listed host
and the path's prefixes of listed lengths are looked up in a Bloom filter whose probes of a key stay in one block of
512 bits; the few keys that pass are joined with the list, which removes false positives. URLs without a possible hit
are allowed where they are, so only the others are dealt out. The longest rule decides; without one, a blocked
listing does. The list is a table: RULES and LISTED are the query's own, listing() reads any other.

Nulls and edges: a null URL, or one without `://`, has an empty host and path and is allowed; of rules of equal
length the later text wins; repeated rows are judged one by one; an empty table or list gives an empty result or
allows all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Scratch, slices
from graphloom.llm.exactdup import small

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of hosts that the method blocks where no rule speaks.
LISTED = [(f"{name}.example.{end}", "/", "block") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]
#: Blocks of 512 bits: at most 64 MB, whatever the list; a fuller filter only passes more keys to the join.
MOST_BLOCKS, BITS_A_KEY, PROBES = 1 << 20, 16, 8
_C = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, rules: list = RULES, listed: list = LISTED) -> DataFrame:
    """(entry, path_chars, verdict, is_rule)"""
    rows = [(h + p, len(p), v, True) for h, p, v in rules] + [(h + p, len(p), v, False) for h, p, v in listed]
    return spark.createDataFrame(rows, "entry string, path_chars int, verdict string, is_rule boolean")


def listing(rows: DataFrame) -> DataFrame:
    """A list's table from rows (host, path, verdict, is_rule); hosts are lower-cased, and a null path is the root."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit("/"))
    return rows.where("host IS NOT NULL").select(F.concat(host, path).alias("entry"), F.length(path).alias("path_chars"), "verdict", "is_rule")


def places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its PROBES bits in the block."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) & np.uint64(blocks - 1)).astype(np.int64)
    low = (h * _C)[:, None] ^ (h[:, None] >> np.uint64(7))
    bits = (low * (np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))) >> np.uint64(55)
    return block, bits.astype(np.int64)


def bloom(entries: DataFrame) -> tuple[np.ndarray, int]:
    """The filter's words and its number of blocks; built where the rows are and ORed by word."""
    n = entries.count()
    blocks = 1
    while blocks < min(MOST_BLOCKS, n * BITS_A_KEY / 512):
        blocks *= 2

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = places([x.encode() for x in batch.column("entry").to_pylist()], blocks)
            word = (block[:, None] * 8 + bits // 64).ravel()
            one = (np.uint64(1) << (bits % 64).astype(np.uint64)).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(one)], ["word", "bits"])

    words = np.zeros(blocks * 8, np.int64)
    if n:
        rows = entries.select("entry").mapInArrow(fn, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64), blocks


def probe(words: np.ndarray, blocks: int, keys: list[bytes]) -> np.ndarray:
    block, bits = places(keys, blocks)
    return (words[block[:, None] * 8 + bits // 64] >> (bits % 64).astype(np.uint64) & np.uint64(1)).all(1)


def split(url: str | None) -> tuple[str, str]:
    """Canonical host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, rest = rest[:end].encode().translate(LOWER).decode(), rest[end:]
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    return host, rest[:stop]


def keys_of(host: str, path: str, lengths: list[int], deepest: int) -> list[str]:
    """What a list whose hosts have so many labels at most may hold of a URL."""
    if not host:
        return []
    labels = host.rsplit(".", deepest)[-deepest:]
    tails = [".".join(labels[i:]) for i in range(len(labels))]
    return [t + path[:n] for n in lengths if n <= len(path) for t in tails]


def judge(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages."""
    spark = pages.sparkSession
    words, blocks = bloom(entries)
    host_of = F.expr("left(entry, length(entry) - path_chars)")
    # no more lengths than a URL is long, and one number
    shape = entries.agg(F.array_sort(F.collect_set("path_chars")), F.max(F.length(host_of) - F.length(F.translate(host_of, ".", "")) + 1)).first()
    lengths, deepest = shape[0], shape[1] or 1
    shared = spark.sparkContext.broadcast(words)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [split(u) for u in batch.column("url").to_pylist()]
            keys = [keys_of(h, p, lengths, deepest) for h, p in parts]
            flat = [k for x in keys for k in x]
            ok = iter(probe(shared.value, blocks, [k.encode() for k in flat]).tolist() if flat else ())
            hits = [[k for k in x if next(ok)] for x in keys]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(hits, pa.list_(pa.string()))], ["page_id", "host", "path", "hits"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(fn, "page_id long, host string, path string, hits array<string>")
    rows = Scratch(spark, "urls").save(rows.withColumn("uid", F.monotonically_increasing_id()), "hits")
    # a row for each possible hit; the list's side is small or the join is shuffled
    found = rows.where(F.size("hits") > 0).withColumn("key", F.explode("hits")).drop("hits").join(small(entries), F.col("key") == F.col("entry"), "left")
    rank = F.when(F.col("is_rule"), F.concat(F.lpad(F.length("entry").cast("string"), 9, "0"), F.col("entry"), F.lit("\x00"), F.col("verdict")))
    out = found.groupBy("uid", "page_id", "host", "path").agg(F.max(rank).alias("best"), F.max(F.when(~F.col("is_rule"), F.col("verdict") == "block")).alias("listed"))
    rule = F.substring_index(F.expr("substring(best, 10)"), "\x00", 1)
    method = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    judged = out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(F.substring_index("best", "\x00", -1), method).alias("verdict"))
    free = rows.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return free.unionByName(judged)
