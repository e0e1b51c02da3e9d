"""Session analytics over append-only events (AG-6 to AG-12, WN-3 to WN-7, LG-1 to LG-3, LG-5, LG-10 to LG-16, SRC-14).

Events are typed rows. Whatever was not observed stays null: sums come with the number of rows that are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RETAIN = 10_000
#: The token counters of the two clients' transcripts.
COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def ring(events: DataFrame, order: str, most: int = RETAIN) -> DataFrame:
    """SRC-14, SM-8: the last `most` events by a dense sequence number; its largest value travels, not the events."""
    top = events.agg(F.max(order).alias("__top"))
    return events.crossJoin(F.broadcast(top)).where(F.col(order) > F.col("__top") - most).drop("__top")


def latest_phase(events: DataFrame, key: str, phase: str, order: str, first: str = "completed") -> DataFrame:
    """AG-12: one row a key, completed before invoked, then the latest."""
    w = W.partitionBy(key).orderBy((F.col(phase) == first).desc(), F.col(order).desc())
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cumulative_last(events: DataFrame, session: str, order: str, counters: list[str]) -> DataFrame:
    """AG-7, WN-4: each session's last snapshot of cumulative counters, and how often the first counter fell."""
    w = W.partitionBy(session).orderBy(order)
    fell = (F.col(counters[0]) < F.lag(counters[0]).over(w)).cast("long")
    return events.withColumn("__fell", F.coalesce(fell, F.lit(0))).groupBy(session).agg(*[F.max_by(c, order).alias(c) for c in counters], F.sum("__fell").alias("n_resets"))


def deduplicated_sum(events: DataFrame, session: str, message: str, counters: list[str]) -> DataFrame:
    """AG-6: repeated snapshots of a message count once, at their largest; then sums, and messages that are known."""
    once = events.groupBy(session, message).agg(*[F.max(c).alias(c) for c in counters])
    return once.groupBy(session).agg(*[F.sum(c).alias(c) for c in counters], *[F.count(c).alias(f"{c}_known") for c in counters], F.count("*").alias("n_messages"))


def first_last(events: DataFrame, session: str, order: str, value: str) -> DataFrame:
    """WN-3: the first and last value of a session in event order."""
    return events.groupBy(session).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n_events"))


def after_last(events: DataFrame, session: str, order: str, edit: Column, check: Column) -> DataFrame:
    """WN-5: whether a session has edits after its last check."""
    last = events.groupBy(session).agg(F.max(F.when(edit, F.col(order))).alias("__e"), F.max(F.when(check, F.col(order))).alias("__c"))
    return last.select(session, (F.col("__e").isNotNull() & (F.col("__c").isNull() | (F.col("__e") > F.col("__c")))).alias("unchecked_edits"))


def tally(events: DataFrame, session: str, name: str) -> DataFrame:
    """AG-8: a sorted map of name to count."""
    n = events.groupBy(session, name).agg(F.count("*").alias("__n"))
    return n.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "__n")))).alias("counts"))


def calls(events: DataFrame, call: str, name: str, source: str) -> DataFrame:
    """LG-2: one row a call, its first name, its sources, and whether events disagree on the name."""
    return events.groupBy(call).agg(F.min(name).alias("name"), F.array_sort(F.collect_set(source)).alias("sources"), (F.countDistinct(name) > 1).alias("conflict"))


def completions(started: DataFrame, results: DataFrame, call: str) -> DataFrame:
    """LG-3: calls with their results; a call without one stays, with nulls."""
    return started.join(results, call, "left")


def token_components(reports: DataFrame) -> DataFrame:
    """LG-12: uncached input for a client that counts cached input within it; the other's are disjoint."""
    within = F.col("client") == "a"
    return reports.withColumn("uncached_input_tokens", F.when(within, F.col("input_tokens") - F.col("cached_input_tokens")).otherwise(F.col("input_tokens")))


def session_reports(events: DataFrame) -> DataFrame:
    """LG-1: one row a session of typed events (session, client, seq, ts, kind, message_id, call_id, name, ok, counters).

    Client a states cumulative counters, of which the last counts; client b states them a message, of which repeated
    snapshots count once. Child events of other sessions are flagged and left out.
    """
    own = events.where(~F.coalesce("sidechain", F.lit(False)))
    usage = own.where("kind = 'usage'")
    a = cumulative_last(usage.where("client = 'a'"), "session", "seq", list(COUNTERS))
    b = deduplicated_sum(usage.where("client = 'b'"), "session", "message_id", list(COUNTERS)).withColumn("n_resets", F.lit(0).cast("long"))
    used = a.select("session", *COUNTERS, "n_resets").union(b.select("session", *COUNTERS, "n_resets"))
    made = own.where("kind = 'call'").groupBy("session", "call_id").agg(F.min("name").alias("name"), F.max("command").alias("command"), F.min("seq").alias("seq"))
    done = own.where("kind = 'result'").groupBy("session", "call_id").agg(F.max("ok").alias("ok"))
    per = made.join(done, ["session", "call_id"], "left").groupBy("session").agg(
        F.count("*").alias("n_calls"), F.count_if("ok").alias("n_passed"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if(F.col("ok").isNull()).alias("n_unfinished"),
        (F.coalesce(F.max(F.when(F.col("command") == "edit", F.col("seq"))), F.lit(-1)) > F.coalesce(F.max(F.when((F.col("command") == "check") & F.col("ok").isNotNull(), F.col("seq"))), F.lit(-1))).alias("unchecked_edits"),
    )
    span = events.groupBy("session").agg(F.first("client").alias("client"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"), F.coalesce(F.max("sidechain"), F.lit(False)).alias("has_children"))
    out = span.join(used, "session", "left").join(per, "session", "left")
    warn = lambda c, text: F.when(c, F.lit(text))
    warnings = F.array_compact(F.array(warn(F.col("total_tokens").isNull(), "no usage"), warn(F.col("n_resets") > 0, "a counter decreased"), warn(F.col("n_unfinished") > 0, "calls without a result"), warn(F.col("has_children"), "child sessions left out")))
    return out.withColumn("warnings", warnings).withColumn("comparable", F.col("total_tokens").isNotNull() & (F.coalesce("n_resets", F.lit(0)) == 0))


def attention(reports: DataFrame) -> DataFrame:
    """LG-15: ordered suggestions."""
    rules = ((F.col("total_tokens").isNull(), "record usage"), (F.coalesce("unchecked_edits", F.lit(False)), "run the checks after the last edit"), (F.coalesce(F.col("n_failed") > F.col("n_passed"), F.lit(False)), "most calls failed"))
    return reports.withColumn("attention", F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])))


def profile(evidence: DataFrame) -> DataFrame:
    """LG-14: complete only if every observed request is linked, and there is one."""
    return evidence.withColumn("profile", F.when((F.col("observed") > 0) & (F.col("observed") == F.col("linked")), "complete").otherwise("incomplete_attribution"))


def retrieval_evidence(ledger: DataFrame) -> DataFrame:
    """LG-13, AG-9: by tool, requests, sums and how many of them are known, from one row an observation."""
    once = latest_phase(ledger, "observation_id", "phase", "seq")
    return once.groupBy("tool").agg(F.count("*").alias("requests"), F.sum("response_bytes").alias("response_bytes"), F.count("response_bytes").alias("response_bytes_known"), F.sum("result_count").alias("result_count"), F.count("result_count").alias("result_count_known"), F.count_if("truncated").alias("truncated"), F.median("duration_ms").alias("median_ms"))


def cohorts(reports: DataFrame, keys: list[str], values: list[str], passed: Column | None = None) -> DataFrame:
    """AG-10/11, LG-10/11: exact medians a cohort, over all and over passed sessions, with missing counts."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.median(v).alias(f"median_{v}"), F.count_if(F.col(v).isNull()).alias(f"missing_{v}")]
        if passed is not None:
            aggs.append(F.median(F.when(passed, F.col(v))).alias(f"median_passed_{v}"))
    return reports.groupBy(*keys).agg(*aggs)


def distinct_sessions(reports: DataFrame, key: str = "session") -> DataFrame:
    """LG-10: the reports; a session that comes twice is an error."""
    if not reports.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a session has more than one report")
    return reports


def labelled(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """LG-16, SM-9: labels of the same snapshot; a label of another is stale."""
    j = reports.join(labels.withColumnRenamed("snapshot_key", "__key"), "session", "left")
    fits = F.col("__key") == F.col("snapshot_key")
    return j.withColumn("label_state", F.when(F.col("__key").isNull(), "none").when(fits, "current").otherwise("stale")).withColumn("label", F.when(fits, F.col("label"))).drop("__key")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WN-7: the newest row a key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
