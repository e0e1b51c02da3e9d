"""What a server records of its requests, and strict measures of whole transcripts (LG-4, LG-18, LG-19)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The counters of a result's usage, all of which must be there.
USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
RECORD = "seq long, observation_id string, phase string, timestamp double, tool string, status string, index_generation string, duration_ms double, response_bytes long, result_count long, truncated boolean, freshness string, refreshed boolean, semantic_status string"
_RESULT = (
    "uuid string, type string, subtype string, is_error boolean, result string, usage string, total_cost_usd double, duration_ms double, num_turns long, "
    "message struct<content: array<struct<type: string, name: string, input: string>>>"
)


def identities(calls: DataFrame) -> DataFrame:
    """LG-4: one row an observation of calls (call_id, observation_id, name, status, sources, seq).

    The server's id is the stronger one; a call without it stands for itself. Sources are united, and of the states
    the first that is known counts.
    """
    key = F.coalesce("observation_id", "call_id")
    known = F.struct((F.col("status") == "unknown").alias("late"), "seq")
    return calls.groupBy(key.alias("identity")).agg(
        F.min_by("name", "seq").alias("name"), F.min_by("status", known).alias("status"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count("*").alias("n_calls"),
    )


def measured(lines: DataFrame) -> DataFrame:
    """LG-18: one row a transcript (file, seq, value) of JSON lines: what its results state, once and without conflict.

    Events that repeat a uuid count once. Tokens are those of the final result's usage and only if every counter is a
    whole number. status is malformed, no_result, conflicting_results, budget_exhausted, error_result, usage_missing or ok.
    """
    raw = lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", _RESULT, {"mode": "PERMISSIVE"}))
    is_object = F.coalesce(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull(), F.lit(False))
    raw = raw.withColumn("ok", is_object)
    bad = raw.groupBy("file").agg(F.count_if(~F.col("ok")).alias("malformed_lines"))
    key = F.coalesce("j.uuid", F.concat(F.lit("#"), F.col("seq").cast("string")))
    events = raw.where("ok").groupBy("file", key.alias("k")).agg(F.min_by(F.struct("seq", "j", "value"), "seq").alias("e")).select("file", "e.*")
    result = F.col("j.type") == "result"
    whole = F.lit(True)
    for c in USAGE:
        whole = whole & F.coalesce(F.get_json_object("value", f"$.usage.{c}").rlike(r"^-?\d+$"), F.lit(False))
    total = sum((F.coalesce(F.get_json_object("value", f"$.usage.{c}").cast("long"), F.lit(0)) for c in USAGE), F.lit(0).cast("long"))
    stated = F.struct("j.subtype", "j.is_error", "j.result", "j.usage", "j.total_cost_usd")
    tools = F.flatten(F.collect_list(F.when(F.col("j.type") == "assistant", F.transform(F.filter("j.message.content", lambda c: c["type"] == "tool_use"), lambda c: c["name"]))))
    per = events.groupBy("file").agg(
        F.count("*").alias("events"), F.count_if(result).alias("n_results"), F.countDistinct(F.when(result, F.to_json(stated))).alias("n_stated"), F.size(tools).alias("n_tool_calls"),
        F.max_by(F.when(result, F.struct("j.subtype", "j.is_error", "j.total_cost_usd", whole.alias("whole"), total.alias("tokens"))), F.when(result, F.col("seq"))).alias("r"),
    )
    out = bad.join(per, "file", "left").na.fill(0, ["events", "n_results", "n_stated", "n_tool_calls"])
    one = (F.col("n_results") > 0) & (F.col("n_stated") == 1)
    sub = F.coalesce("r.subtype", F.lit(""))
    status = (
        F.when(F.col("n_results") == 0, F.when((F.col("malformed_lines") > 0) & (F.col("events") == 0), "malformed").otherwise("no_result")).when(~one, "conflicting_results").when(F.contains(sub, F.lit("budget")), "budget_exhausted")
        .when(F.coalesce("r.is_error", F.lit(False)) | ((sub != "") & (sub != "success")), "error_result").when(~F.col("r.whole"), "usage_missing").otherwise("ok")
    )
    return out.select("file", status.alias("status"), F.when(one & F.col("r.whole"), F.col("r.tokens")).alias("tokens"), F.when(one, F.col("r.total_cost_usd")).alias("cost_usd"), "n_tool_calls", "events", "malformed_lines")


class Observer:
    """LG-19: wraps requests and keeps two records of each, invoked and completed, until they are appended to a ledger."""

    def __init__(self, generation: Callable[[], str | None], first: int = 0):
        self.generation, self.records, self.seq = generation, [], first

    def _note(self, **record) -> None:
        self.seq += 1
        self.records.append({"seq": self.seq, "timestamp": time.time(), **record})

    def call(self, tool: str, request: Callable[[], object]) -> object:
        """The request's answer; what it raises is recorded by its kind and raised again."""
        own = {"observation_id": uuid.uuid4().hex, "tool": tool}
        self._note(**own, phase="invoked")
        began, status, answer = time.perf_counter(), "ok", None
        try:
            answer = request()
            return answer
        except Exception as e:
            status = type(e).__name__
            raise
        finally:
            shown = answer if isinstance(answer, dict) else getattr(answer, "__dict__", {})
            items = shown.get("items")
            self._note(
                **own, phase="completed", status=status, duration_ms=round((time.perf_counter() - began) * 1000, 3), index_generation=self.generation(), result_count=len(items) if isinstance(items, list) else None,
                response_bytes=len(json.dumps(shown, default=str).encode()) if status == "ok" else None, truncated=shown.get("truncated"), freshness=shown.get("freshness"),
            )

    def append(self, spark: SparkSession, path: str) -> None:
        """Adds what was kept to a ledger of Parquet files."""
        names = [x.split()[0] for x in RECORD.split(", ")]
        spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.records], RECORD).coalesce(1).write.mode("append").parquet(path)
        self.records = []
