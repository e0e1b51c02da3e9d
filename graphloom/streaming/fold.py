"""Incremental folding of session events (SM-1 to SM-8) with Structured Streaming.

State of a session is bounded: its counters, the ids of its last RECENT events, and the largest counters of its last
OPEN messages; those of earlier messages are in a sum. Events come in the order of their sequence numbers but for the
last RECENT, so one below all that are remembered is a repeat. Late or repeated events change nothing twice. A
session's report is overwritten by its key, so a batch that is replayed gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECENT, OPEN = 2000, 500
REPORT = "session string, n_events long, n_calls long, n_malformed long, n_children long, total_tokens long, last_seq long"
STATE = "n long, calls long, bad long, children long, last_seq long, floor long, total_seq long, total long, closed long, messages string, seen string"


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, calls, bad, children, last_seq, floor, total_seq, total, closed, messages, seen = state.get if state.exists else (0, 0, 0, 0, -1, -1, -1, -1, 0, "{}", "{}")
    per, known = json.loads(messages), json.loads(seen)
    for part in parts:
        new = part.drop_duplicates("event_id")
        new = new[(new["seq"] > floor) & ~new["event_id"].isin(known.keys())]
        if not len(new):
            continue
        known.update(zip(new["event_id"], new["seq"].astype(int).tolist(), strict=True))
        last_seq = max(last_seq, int(new["seq"].max()))
        side = new["sidechain"].fillna(False).astype(bool)
        children, new = children + int(side.sum()), new[~side]
        kinds = new["kind"].value_counts()
        n, bad, calls = n + len(new), bad + int(kinds.get("malformed", 0)), calls + int(kinds.get("call", 0))
        usage = new[(new["kind"] == "usage") & new["total_tokens"].notna()]
        stated = usage[usage["client"] == "a"].sort_values("seq")
        if len(stated) and int(stated["seq"].iloc[-1]) > total_seq:
            total_seq, total = int(stated["seq"].iloc[-1]), int(stated["total_tokens"].iloc[-1])
        for m, rows in usage[usage["client"] != "a"].groupby("message_id", dropna=False, sort=False):
            old, at = per.get(str(m), (0, -1))
            per[str(m)] = max(old, int(rows["total_tokens"].max())), max(at, int(rows["seq"].max()))
    if len(known) > RECENT:
        known = dict(sorted(known.items(), key=lambda x: (x[1], x[0]))[-RECENT:])
        floor = min(known.values()) - 1
    if len(per) > OPEN:
        done = sorted(per, key=lambda m: (per[m][1], m))[:-OPEN]
        closed += sum(per.pop(m)[0] for m in done)
    state.update((n, calls, bad, children, last_seq, floor, total_seq, total, closed, json.dumps(per), json.dumps(known)))
    tokens = total if total >= 0 else closed + sum(x for x, _ in per.values()) if per else None
    yield pd.DataFrame([(key[0], n, calls, bad, children, tokens, last_seq)], columns=[x.split()[0] for x in REPORT.split(", ")]).astype({"total_tokens": "Int64"})


def fold(events: DataFrame) -> DataFrame:
    """A report row a session whenever its state changes; events need an event_id of their own (a hash of place).

    Events of child sessions (sidechain) are counted apart and change nothing else (SM-6).
    """
    rows = events if "sidechain" in events.columns else events.withColumn("sidechain", F.lit(False))
    rows = rows.withColumn("event_id", F.concat_ws(":", F.col("seq").cast("string"), "kind", F.coalesce("call_id", "message_id", F.lit(""))))
    rows = rows.select("session", "client", "seq", "kind", "message_id", "total_tokens", "sidechain", "event_id")
    return rows.groupBy("session").applyInPandasWithState(_fold, REPORT, STATE, "update", GroupStateTimeout.NoTimeout)


def watch(events: DataFrame, path: str, interval: str | None = None):
    """SM-7: the running query that folds events into reports under path, every interval, or once to the end of what is there."""
    writer = fold(events).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda df, n: publish(df, n, f"{path}/reports"))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def publish(reports: DataFrame, batch: int, path: str) -> None:
    """foreachBatch: the newest report of each session, merged into the table and swapped in as a new version."""
    spark = reports.sparkSession
    new = reports.withColumn("batch", F.lit(batch).cast("long"))
    try:
        old = spark.read.parquet(f"{path}/v={batch - 1}") if batch else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    out = new if old is None else new.unionByName(old.join(new.select("session"), "session", "left_anti"))
    out.write.mode("overwrite").parquet(f"{path}/v={batch}")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events by type in event-time windows, with a watermark for late data."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
