"""Transcripts of two clients as typed events, in batch and as a stream (SRC-11 to SRC-13, SRC-16, LG-1).

Lines are read as text and parsed leniently; a line that does not parse is a row of kind `malformed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import command_kinds, exit_codes

USAGE_A = "total_token_usage: struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long, total_tokens: long>"
LINE = (
    "type string, timestamp string, sessionId string, isSidechain boolean, "
    f"payload struct<type: string, id: string, model: string, call_id: string, name: string, arguments: string, output: string, info: struct<{USAGE_A}>>, "
    "message struct<id: string, model: string, usage: struct<input_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long, output_tokens: long>, "
    "content: array<struct<type: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean>>>"
)
EVENT = "session string, client string, seq long, ts string, kind string, message_id string, call_id string, name string, command string, ok boolean, sidechain boolean, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value) of JSON lines, numbered in file order."""
    from pyspark.sql import Window as W

    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return raw.withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy("at")).cast("long")).drop("at")


def events(rows: DataFrame, client: str) -> DataFrame:
    """Typed events of lines (file, seq, value); works on a stream as well, as it is a projection."""
    j = rows.withColumn("j", F.from_json("value", LINE, {"mode": "PERMISSIVE"})).withColumn("bad", F.col("j").isNull() | (F.col("j.type").isNull() & F.col("j.message").isNull() & F.col("j.payload").isNull()))
    null = lambda t: F.lit(None).cast(t)
    if client == "a":
        p = F.col("j.payload")
        kind = F.when(F.col("bad"), "malformed").when(p["info"].isNotNull(), "usage").when(p["type"] == "function_call", "call").when(p["type"] == "function_call_output", "result").otherwise("other")
        code = exit_codes(p["output"])
        u = p["info"]["total_token_usage"]
        return j.select(
            F.col("file").alias("session"), F.lit("a").alias("client"), "seq", F.col("j.timestamp").alias("ts"), kind.alias("kind"), null("string").alias("message_id"), p["call_id"].alias("call_id"), p["name"].alias("name"),
            command_kinds(p["name"], p["arguments"]).alias("command"), F.when(kind == "result", code == 0).alias("ok"), F.lit(False).alias("sidechain"), p["model"].alias("model"),
            *[u[c].alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")],
        )
    m = F.col("j.message")
    u = m["usage"]
    side = F.coalesce(F.col("j.isSidechain"), F.lit(False))
    total = u["input_tokens"] + F.coalesce(u["cache_creation_input_tokens"], F.lit(0)) + F.coalesce(u["cache_read_input_tokens"], F.lit(0)) + u["output_tokens"]
    own = j.select("file", "seq", "bad", side.alias("side"), F.col("j.timestamp").alias("ts"), m["id"].alias("mid"), m["model"].alias("model"), u.alias("u"), total.alias("total"), m["content"].alias("content"))
    usage = own.where("bad OR u IS NOT NULL").select(
        F.col("file").alias("session"), F.lit("b").alias("client"), "seq", "ts", F.when(F.col("bad"), "malformed").otherwise("usage").alias("kind"), F.col("mid").alias("message_id"), null("string").alias("call_id"), null("string").alias("name"),
        null("string").alias("command"), null("boolean").alias("ok"), F.col("side").alias("sidechain"), "model", F.col("u.input_tokens").alias("input_tokens"), F.col("u.cache_read_input_tokens").alias("cached_input_tokens"), F.col("u.output_tokens").alias("output_tokens"),
        null("long").alias("reasoning_output_tokens"), F.col("total").alias("total_tokens"),
    )
    block = own.select("*", F.explode("content").alias("c")).where("c.type IN ('tool_use', 'tool_result')")
    use = F.col("c.type") == "tool_use"
    calls = block.select(
        F.col("file").alias("session"), F.lit("b").alias("client"), "seq", "ts", F.when(use, "call").otherwise("result").alias("kind"), F.col("mid").alias("message_id"), F.coalesce("c.id", "c.tool_use_id").alias("call_id"), F.col("c.name").alias("name"),
        command_kinds(F.col("c.name"), F.col("c.input")).alias("command"), F.when(~use, ~F.coalesce("c.is_error", F.lit(False))).alias("ok"), F.col("side").alias("sidechain"), "model", *[null("long").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")],
    )
    return usage.union(calls)


def stream(spark: SparkSession, path: str, client: str) -> DataFrame:
    """SRC-12: events of files that appear under path; the query's checkpoint remembers which were read."""
    raw = spark.readStream.text(path, wholetext=False)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("seq"))
    return events(rows, client)


def junit(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: (name, tests, failures, errors, skipped) of JUnit XML suites."""
    schema = "_name string, _tests long, _failures long, _errors long, _skipped long"
    df = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path)
    return df.select(F.col("_name").alias("name"), *[F.coalesce(f"_{c}", F.lit(0)).alias(c) for c in ("tests", "failures", "errors", "skipped")])
