"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a hashed order, over and over, as often as a document may be taken. A document's
virtual finish time is the source's running words, its own included, over the source's target. The documents of all
sources are taken in the order of their finish times (of equal ones the first source's) until the total budget is
full: whole ones, and of the one that crosses the budget the words that are left. Targets sum to the budget, so the
cut falls near virtual time 1 and a source is off its target by the documents in service there.

The order is a range sort: words are summed up by ranges of virtual time, the range that holds the cut is divided
again until its documents are few, and those are sorted. What is before or behind the cut needs no sorting.

Nulls and edges: a null text has no words and a null source is a source of its own, the last; a document without
words takes none; ties in the hashed order go by doc_id and size, so reruns agree; rows that repeat a doc_id are
documents of their own; an empty table gives an empty result. Extra columns are ignored. Sources are ordered in one
task, so there may be millions of them, but not as many as documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, Scratch
from graphloom.llm.exactdup import SMALL

#: Rows of a window, about; bits of the hashed order; epochs that a document may be taken at most; ranges of virtual time.
RUN, ORDER_BITS, EPOCHS, SPANS = 2048, 60, 3, 4096


def targets(per_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = EPOCHS) -> DataFrame:
    """sid and target for each source's row (source, source_size, n); there is one row a source.

    Sources by code point, null last, take the weights in turn. A target stops at epochs times its source's size,
    and what is left over is shared again by weight among the others until none is above.
    """
    big = lambda c: c.cast("decimal(38,0)")
    s = per_source.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", epochs * F.col("source_size"))
    level = W.orderBy((F.col("cap") / F.col("weight")).asc(), "sid")
    before, rest = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("share", F.sum("weight").over(rest))
    s = s.withColumn("open", big(F.col("cap")) * big(F.col("share")) >= big(F.col("weight")) * big(F.col("left")))
    # the first source that stays below its stop sets the level for itself and all after it
    first = W.partitionBy().orderBy(F.col("open").desc(), F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("l", F.first("left").over(first)).withColumn("w", F.first("share").over(first))
    target = F.when(F.col("open"), (F.col("weight") * F.col("l")).cast("double") / F.col("w").cast("double")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "n", "sid", target.alias("target"))


def known_small(rows: int) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for a side that has so many rows at most, or none."""
    return F.broadcast if rows <= SMALL else lambda df: df


def hashed_order(seed: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


class Cut(NamedTuple):
    """The last copy that the budget reaches, by its finish time, source and running words, and its words that are taken."""

    finish: float
    sid: int
    stop: int
    words: int

    def before(self, finish, sid, stop):
        """Whether a copy comes before it."""
        tie = (sid < self.sid) | ((sid == self.sid) & (stop < self.stop))
        return (finish < self.finish) | ((finish == self.finish) & tie)

    def here(self, sid, stop):
        return (sid == self.sid) & (stop == self.stop)


def stop_of(epoch):
    return epoch * F.col("source_size") + F.col("before") + F.col("size")


def finish_of(epoch):
    return stop_of(epoch).cast("double") / F.greatest(F.col("target"), F.lit(1e-9))


def cut(rows: DataFrame, budget: int, epochs: int) -> Cut:
    """Where the copies of rows, in the order of (finish, sid, stop), have the budget's words together."""
    copies = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.select("size", "sid", stop_of(F.col("epoch")).alias("stop"), finish_of(F.col("epoch")).alias("finish"))
    low, high, ahead = 0.0, 2.0, 0
    while True:
        inside = copies.where((F.col("finish") >= low) & (F.col("finish") < high)) if high < math.inf else copies.where(F.col("finish") >= low)
        width = high - low if high < math.inf else 1e6
        span = F.least(F.floor((F.col("finish") - low) / width * SPANS), F.lit(SPANS - 1))
        found = inside.groupBy(span.alias("span")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()  # SPANS rows at most
        for r in sorted(found):
            if ahead + r["words"] >= budget:
                break
            ahead += r["words"]
        else:
            low, high = high, math.inf
            continue
        if r["n"] <= RUN or r["low"] == r["high"]:
            break
        low, high = r["low"], math.nextafter(r["high"], math.inf)
    few = copies.where((F.col("finish") >= r["low"]) & (F.col("finish") <= r["high"]))
    few = few.withColumn("total", F.sum("size").over(W.orderBy("finish", "sid", "stop").rowsBetween(W.unboundedPreceding, 0)) + F.lit(ahead))
    last = few.where(F.col("total") >= budget).orderBy("total").first()
    return Cut(last["finish"], last["sid"], last["stop"], last["size"] - (last["total"] - budget))


class Queue(NamedTuple):
    """Rows of documents with sid, target, hash and the words before them in their source; and the cut, if there are words."""

    rows: DataFrame
    cut: Cut | None
    sources: int


def queue(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: str) -> Queue:
    tmp = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = tmp.save(sized, "sizes")
    per = tmp.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, epochs), "targets")
    budget, total, sources = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = sized.join(known_small(sources)(per.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / RUN))).cast("int")
    rows = rows.withColumn("hash", hashed_order(seed)).withColumn("bucket", F.floor(F.col("hash") / F.pow(F.lit(2.0), F.lit(ORDER_BITS) - bits)).cast("long"))
    # the words before a row: those of the buckets before its own, and those before it in its bucket of about RUN rows
    offsets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select("sid", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("own", own).join(known_small(sources + 2 * total // RUN)(offsets), ["sid", "bucket"])
    rows = tmp.save(rows.select("doc_id", "source", "size", "sid", "source_size", "target", "hash", (F.col("own") + F.col("offset")).alias("before")), "queue")
    tmp.drop(sized)
    return Queue(rows, cut(rows, budget, epochs) if budget else None, sources)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = EPOCHS, seed: str = "") -> DataFrame:
    """doc_id, size, source, source_size, target, taken and finish (of the first copy), one row per row of docs."""
    q = queue(docs, weights, epochs, seed)
    taken = F.lit(0).cast("long")
    if q.cut:
        for e in range(epochs):
            stop, c = stop_of(F.lit(e)), q.cut
            taken = taken + F.when(F.col("size") == 0, 0).when(c.here(F.col("sid"), stop), c.words).when(c.before(finish_of(F.lit(e)), F.col("sid"), stop), F.col("size")).otherwise(0)
    return q.rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), finish_of(F.lit(0)).alias("finish"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = EPOCHS, seed: str = "") -> DataFrame:
    """The rows of docs as often as the mix takes them, whole, in the columns of docs.

    A document that the budget cuts is taken once more if half of its words are. A document without words stays once.
    What a source gives ends at one document of its hashed order, so a row a source decides and texts stay where they
    are; rows that repeat the doc_id of that document go together.
    """
    q = queue(docs, weights, epochs, seed)
    if not q.cut:
        return docs
    copies = q.rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("stop", stop_of(F.col("epoch")))
    here = q.cut.here(F.col("sid"), F.col("stop"))
    taken = F.when(here, 2 * q.cut.words >= F.col("size")).otherwise(q.cut.before(finish_of(F.col("epoch")), F.col("sid"), F.col("stop")))
    last = copies.where(taken).groupBy("source").agg(F.max(F.struct("stop", "epoch", "hash", "doc_id")).alias("last"))
    last = last.select(F.col("source").alias("__source"), F.col("last.epoch").alias("__epoch"), F.col("last.hash").alias("__hash"), F.col("last.doc_id").alias("__last"))
    out = docs.join(known_small(q.sources)(last), docs["source"].eqNullSafe(F.col("__source")), "left").withColumn("__own", hashed_order(seed))
    own_id = out["doc_id"].cast("long")
    # ids of one hash stand in their order, null first
    reached = (F.col("__own") < F.col("__hash")) | ((F.col("__own") == F.col("__hash")) & (own_id.isNull() | F.coalesce(own_id <= F.col("__last"), F.lit(False))))
    times = F.when(~F.coalesce(out["text"].rlike(WORD), F.lit(False)), 1).when(F.col("__epoch").isNull(), 0).otherwise(F.col("__epoch") + reached.cast("int"))
    out = out.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*[out[c] for c in docs.columns])
