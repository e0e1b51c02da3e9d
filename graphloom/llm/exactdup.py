"""Exact deduplication against immutable snapshots with static binary fuse filters.

Rows come in batches. Each batch is grouped by digest on its own; an earlier batch is an immutable snapshot with a
binary fuse filter for each bucket of its digests. Later digests are screened by the filters of their bucket, what
passes is joined with the snapshot's exact bucket, and the texts of what is left are compared byte by byte.

Nulls and edges: a null text counts as empty; equal texts are those of the same bytes; of equal texts the row with
the largest doc_id stays (a null doc_id is the smallest), and of rows that repeat that doc_id too just one; an
empty table gives an empty result. Extra columns are ignored, or kept by drop_exact_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import fuse
from graphloom.llm.common import Scratch, grouped, runs

#: Digests of a bucket, about; and rows of a side that may be broadcast (40 bytes each), beyond which it is shuffled.
BUCKET, SMALL = 50_000, 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The frame with a broadcast hint if it has no more rows than most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The first 64 bits of hexadecimal digests."""
    return np.array([int(x[:16], 16) for x in column.to_pylist()], np.uint64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in runs(batches, "unit"):
        keys, batch, bucket = _keys(table.column("digest")), table.column("batch"), table.column("bucket")
        first = at[:-1]
        made = [fuse.build(keys[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.take(first).combine_chunks(), bucket.take(first).combine_chunks(), pa.array(made, pa.binary())], ["batch", "bucket", "filter"])


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    """Digests of later batches that a snapshot's filter passes."""
    keys, batch = _keys(rows.column("digest")), rows.column("batch").to_numpy()
    out = []
    for f, snapshot in zip(filters.column("filter").to_pylist(), filters.column("batch").to_pylist(), strict=True):
        hit = np.flatnonzero((batch > snapshot) & fuse.contains(f, keys))
        out.append(pa.table([rows.column("digest").take(hit), pa.array(np.full(len(hit), snapshot, np.int64))], ["digest", "batch"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], ["digest", "batch"])


def build_filters(entries: DataFrame) -> DataFrame:
    """(batch, bucket, filter) of snapshot entries (batch, bucket, digest)."""
    return grouped(entries.select(F.xxhash64("batch", "bucket").alias("unit"), "batch", "bucket", "digest"), "unit", _build, "batch long, bucket long, filter binary")


def screen(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, batch): entries that the filter of an earlier batch passes, with that batch."""
    return entries.select("bucket", "batch", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe, "digest string, batch long")


def digest_of(column, chars: int = 64):
    return F.substring(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256), 1, chars)


def exact_duplicates(docs: DataFrame, batches: int = 3, chars: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs.

    The rows are dealt into batches, of which all but the last are the snapshots that it meets. chars shortens the
    digest, so that tests can reach the byte check with different texts.
    """
    tmp = Scratch(docs.sparkSession, "exactdup")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("long")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("text_sha256")).withColumn("batch", batch)
    every = tmp.save(every.withColumn("uid", F.monotonically_increasing_id()), "digests").withColumn("digest", F.substring("text_sha256", 1, chars))
    entries = tmp.save(every.groupBy("batch", "digest").agg(F.count("*").alias("n")), "entries")
    buckets = max(1, -(-entries.count() // BUCKET))
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long"))
    snapshots = entries.where(F.col("batch") < batches - 1)
    passed = screen(entries.where("batch > 0"), build_filters(snapshots))
    found = passed.join(snapshots.select("digest", "batch"), ["digest", "batch"], "left_semi").select("digest")
    suspects = tmp.save(found.union(entries.where("n > 1").select("digest")).distinct(), "suspects")

    # the byte check: only the texts of suspects are dealt out, and equal ones are combined before
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest_of(F.col("text"), chars).alias("digest"))
    near = near.join(small(suspects), "digest", "left_semi")
    classes = near.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = tmp.save(classes.select("digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.xxhash64("text").alias("x"), F.length("text").alias("chars"), "keep_id", "group_size"), "classes")
    # a class is known by the whole sha-256; two texts of one sha-256 would be two classes here, which is an error
    out = every.join(small(classes.select("text_sha256", "keep_id", "group_size")), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    out = tmp.save(out.select("uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256"), "rows")
    first = out.where("group_size > 1 AND doc_id <=> keep_id").groupBy("text_sha256").agg(F.min("uid").alias("uid"), F.count("*").alias("same")).where("same > 1")
    first = first.select("text_sha256", F.col("uid").alias("only"))
    out = out.join(small(first), "text_sha256", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("only").isNull() | (F.col("only") == F.col("uid")))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    tmp = Scratch(docs.sparkSession, "exactdup")
    found = tmp.save(exact_duplicates(docs), "found").where("group_size > 1")
    pair = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    stay = found.where("kept").select(*pair)
    lost = found.where("NOT kept").select(*pair).distinct()
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__sha"] == b["__sha"])
    gone = lost.join(stay, same(lost, stay), "left_anti")
    gone = gone.select(F.col("__id").alias("__gone"), F.col("__sha").alias("__gone_sha"))
    out = docs.join(small(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (digest_of(docs["text"]) == F.col("__gone_sha")), "left_anti")
    # rows that repeat both doc_id and text
    return out.dropDuplicates(["doc_id", "text"]) if not lost.join(stay, same(lost, stay), "left_semi").isEmpty() else out
