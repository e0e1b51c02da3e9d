"""Reports over attempts, manifests and evidence (LG-6/8/9, TX-7, EV-17/18/21/22/26 to EV-32, AG-17/21, JN-14/18/19, SRC-13, SNK-10/11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.evaluate import ratio
from graphloom.operators.settle import settle

#: Words of a request that tell what it is about, each at the start of an ASCII word; a letter beyond ASCII is none of a word's.
START = "(?<![0-9A-Za-z_])"
ACTIVITIES = {"fix": "fix|bug|error|fail", "feature": "add|implement|feature", "refactor": "refactor|rename|clean", "test": "test|coverage", "explain": "explain|why|how|what"}


def activities(text: str | Column) -> Column:
    """LG-6: sorted kinds of task that a request's words name."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))  # a dotted capital I is an i and no second character
    return F.array_sort(F.array_compact(F.array(*[F.when(c.rlike(f"{START}({p})"), F.lit(k)) for k, p in ACTIVITIES.items()])))


def assessments(reports: DataFrame) -> DataFrame:
    """LG-8: derived labels, each with where it comes from; what was not observed is unknown."""
    checks = F.when(F.col("n_calls").isNull(), "unknown").when(F.col("n_failed") == 0, "passed").when(F.col("n_passed") == 0, "failed").otherwise("mixed")
    return reports.withColumn("checks", checks).withColumn("checks_from", F.when(F.col("n_calls").isNull(), "nothing observed").otherwise("recorded results"))


def classified(reports: DataFrame, exclusions: dict[str, Column]) -> DataFrame:
    """LG-9: comparable, or excluded with every reason."""
    why = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in exclusions.items()]))
    return reports.withColumn("excluded_because", why).withColumn("comparable", F.size(why) == 0)


def conditions(attempts: DataFrame, by: list[str]) -> DataFrame:
    """AG-17: means, medians, correctness and costs a condition."""
    return attempts.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.median("tokens").alias("median_tokens"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("correct_rate"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("cost_unknown"))


def robustness(runs: DataFrame, group: str, variant: str) -> DataFrame:
    """AG-21: variants, the share of valid runs and of passed ones."""
    return runs.groupBy(group).agg(F.countDistinct(variant).alias("variants"), F.round(F.avg(F.col("valid").cast("double")), 4).alias("valid_rate"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


def verdict(summary: DataFrame, ratio_bound: float = 1.25) -> DataFrame:
    """EV-21: GO if the ratio reaches its bound and correctness does not fall, INCOMPLETE without figures, else STOP."""
    missing = F.col("token_ratio").isNull() | F.col("correct_baseline").isNull() | F.col("correct_treatment").isNull()
    return summary.withColumn("verdict", F.when(missing, "INCOMPLETE").when((F.col("token_ratio") >= ratio_bound) & (F.col("correct_treatment") >= F.col("correct_baseline")), "GO").otherwise("STOP"))


def recall_gate(before: DataFrame, after: DataFrame, vague: str, exact: str, gain: float = 0.10) -> DataFrame:
    """EV-22: passed if vague queries gain ten points and exact ones lose nothing."""
    j = before.withColumnRenamed("recall", "b").join(after.withColumnRenamed("recall", "a"), "category")
    of = lambda c, x: F.max(F.when(F.col("category") == c, F.col(x)))
    return j.agg((of(vague, "a") - of(vague, "b")).alias("gain"), (of(exact, "a") >= of(exact, "b")).alias("exact_kept")).withColumn("passed", (F.col("gain") >= gain) & F.col("exact_kept"))


def miss_categories(misses: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """EV-17: why edges were missed, by the first pattern that fits."""
    c = F.lit("other")
    for name, p in reversed(list(patterns.items())):
        c = F.when(F.col(text).rlike(p), name).otherwise(c)
    return misses.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


def manifest(files: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """EV-29: each file included, or excluded for the first rule that fits."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])
    return files.withColumn("reason", reason).withColumn("included", reason.isNull())


def verdicts(*records: DataFrame) -> DataFrame:
    """EV-30: adjudications of several files as one histogram; a record that repeats counts once."""
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    return out.distinct().groupBy("relation", "verdict").agg(F.count("*").alias("n"))


def admission(edges: DataFrame, files: int = 3, foreign: int = 3) -> DataFrame:
    """EV-31: counts of symbols called from several files, and of symbols that call several foreign ones.

    edges are (source_key, source_file, target_key, target_file).
    """
    other = edges.where("source_file <> target_file")
    called = other.groupBy("target_key").agg(F.countDistinct("source_file").alias("n")).where(F.col("n") >= files)
    calling = other.groupBy("source_key").agg(F.countDistinct("target_key").alias("n")).where(F.col("n") >= foreign)
    return called.agg(F.lit("called from files").alias("structure"), F.count("*").alias("n")).union(calling.agg(F.lit("calls foreign symbols"), F.count("*")))


def tokens(chars: Column) -> Column:
    """EV-32: a token is about four characters."""
    return F.round(chars / 4).cast("long")


def size_ratio(rows: DataFrame, baseline: str, ours: str) -> DataFrame:
    """EV-32: estimated tokens of two answers and their ratio."""
    return rows.withColumn("baseline_tokens", tokens(F.length(baseline))).withColumn("our_tokens", tokens(F.length(ours))).withColumn("ratio", ratio(F.col("baseline_tokens"), F.col("our_tokens")))


def linked(transcript: DataFrame, ledger: DataFrame) -> DataFrame:
    """JN-14: observations that a transcript names and the ledger has, by their exact ids and never by time."""
    named = transcript.select("session", F.explode("observation_ids").alias("observation_id")).distinct()
    known = ledger.select("observation_id").distinct().withColumn("__l", F.lit(1))
    return named.join(known, "observation_id", "left").groupBy("session").agg(F.count("*").alias("observed"), F.count("__l").alias("linked"))


def enriched(items: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """TX-7: the first definitions in each item's span, the first relationships of its file, and whether there are more."""
    key = ["path", "start_line", "end_line"]
    inside = items.select(*key).join(symbols.select("name", F.col("file_path").alias("path"), F.col("start_line").alias("line")), "path").where("line BETWEEN start_line AND end_line")
    defs = inside.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("line", "name"))).where(F.col("k") <= most + 1)
    defs = defs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("d"))
    rel = items.select("path").distinct().join(edges.select(F.col("source_key").alias("path"), "relation", "target_key"), "path")
    rel = rel.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("relation", "target_key"))).where(F.col("k") <= most + 1)
    rel = rel.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "relation", "target_key").alias("r")))).alias("r"))
    out = items.join(defs, key, "left").join(rel, "path", "left")
    names = lambda c, f: F.transform(F.slice(F.coalesce(c, F.array()), 1, most), lambda x: x[f])
    more = (F.coalesce(F.size("d"), F.lit(0)) > most) | (F.coalesce(F.size("r"), F.lit(0)) > most)
    return out.withColumn("definitions", F.when(F.col("d").isNotNull(), names(F.col("d"), "name"))).withColumn("relationships", F.when(F.col("r").isNotNull(), names(F.col("r"), "r"))).withColumn("truncated", more).drop("d", "r")


def unrepeated(ranked: DataFrame, place: str = "place") -> DataFrame:
    """JN-19: the text of a span that overlaps an earlier one of its file is not told again.

    Equal spans count once, with their first place. Of two that overlap one starts within the other, so each span is
    cut into dyadic ranges of lines and meets the starts in them, and each start the spans that hold it, by equal keys.
    """
    own = ranked.select("path", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z"), F.col(place).alias("k"))
    spans = settle(own.where("a IS NOT NULL AND z IS NOT NULL").groupBy("path", "a", "z").agg(F.min("k").alias("k")).where("path IS NOT NULL AND k IS NOT NULL"))
    told, odd = spans.where("a <= z"), spans.where("a > z")
    longest = told.agg(F.max(F.col("z") - F.col("a"))).first()[0] or 0
    level = F.explode(F.sequence(F.lit(0), F.lit((longest + 1).bit_length() - 1))).alias("level")
    # of a level's ranges [low, high) within a span, those that no range of the next level holds: an odd first, an even last
    lo, hi = F.expr("-shiftright(-a, level)"), F.expr("shiftright(z + 1, level)")
    ends = F.array(F.when(F.col("low") % 2 != 0, F.col("low")), F.when(F.col("high") % 2 != 0, F.col("high") - 1))
    cut = told.select("*", level).select("*", lo.alias("low"), hi.alias("high")).where("low < high").select("path", "a", "z", "k", "level", F.explode(F.array_compact(ends)).alias("range"))
    starts = told.groupBy("path", "a").agg(F.min("k").alias("k")).select("path", "a", "k", level).withColumn("range", F.expr("shiftright(a, level)"))
    at = ["path", "level", "range"]
    inside = cut.drop("k").join(starts.groupBy(*at).agg(F.min("k").alias("k")), at).select("path", "a", "z", "k")
    around = starts.drop("k").join(cut.groupBy(*at).agg(F.min("k").alias("k")), at).groupBy("path", "a").agg(F.min("k").alias("k"))
    around = told.drop("k").join(around, ["path", "a"]).select("path", "a", "z", "k")
    # spans that end before they start hold no line; they meet the spans that go from before their end to after their start
    x, y = (f.select("path", *[F.col(c).alias(p + c) for c in ("a", "z", "k")]) for f, p in ((odd, "x"), (told, "y")))
    pairs = x.join(y, "path").where("xa <= yz AND ya <= xz")
    odd_ = pairs.groupBy("path", F.col("xa").alias("a"), F.col("xz").alias("z")).agg(F.min("yk").alias("k")).union(pairs.groupBy("path", "ya", "yz").agg(F.min("xk")))
    first = inside.union(around).union(odd_).groupBy("path", "a", "z").agg(F.min("k").alias("__k"))
    kept = ranked.join(first.withColumnsRenamed({"path": "__p", "a": "__a", "z": "__z"}), (F.col("path") == F.col("__p")) & (F.col("start_line") == F.col("__a")) & (F.col("end_line") == F.col("__z")), "left")
    return kept.where(F.col("__k").isNull() | F.col(place).isNull() | (F.col(place) <= F.col("__k"))).select(*ranked.columns)


def discovered(heads: DataFrame, repos: DataFrame) -> DataFrame:
    """SRC-13: transcripts whose bounded header names a registered repository."""
    return heads.join(repos.select("repo"), "repo", "left_semi")


def attempts(spark, path: str, schema: str) -> DataFrame:
    """SNK-10: immutable JSON attempts of a folder; the last of a session and attempt number counts."""
    return spark.read.schema(schema).json(f"{path}/*.json").dropDuplicates(["session_id", "attempt"])


def pending(schedule: DataFrame, made: DataFrame, most: int = 2) -> DataFrame:
    """SNK-10: what of a schedule (session_id) is left to do by inspection of its attempts: no valid one, and fewer than `most`."""
    done = made.groupBy("session_id").agg(F.bool_or("valid").alias("valid"), F.count("*").alias("n")).where(F.col("valid") | (F.col("n") >= most))
    return schedule.join(done.select("session_id"), "session_id", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-11"""
    df.write.mode("overwrite").option("header", True).csv(path)


def provenance(summary: DataFrame, inputs: DataFrame) -> DataFrame:
    """EV-27: inputs (name, text) whose digest is not the one that a summary (name, sha256) states."""
    now = inputs.select("name", F.sha2(F.col("text").cast("binary"), 256).alias("now"))
    return summary.join(now, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name")


def call_sites(texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """TX-10: textual calls of a name, without lines that define it or are comments."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("__line")).where(~F.col("__line").rlike(rf"^\s*(#|//|def\s+{name}\b|function\s+{name}\b)"))
    return lines.groupBy(key).agg(F.sum(F.regexp_count("__line", F.lit(rf"\b{name}\("))).cast("long").alias("n"))


def kpis(reports: DataFrame) -> DataFrame:
    """LG-17: one row of totals; sums come with how many sessions they know."""
    return reports.agg(F.count("*").alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.count("total_tokens").alias("sessions_with_usage"), F.sum("n_calls").alias("calls"), F.sum("n_failed").alias("failed"), F.round(F.avg("total_tokens"), 4).alias("mean_tokens"))


def same_stem(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """GR-9: test files whose name is a seed's with test_ before or _test behind it: a heuristic, not an edge."""
    from graphloom.functions.scalar import stem

    bare = lambda c: F.regexp_replace(F.regexp_replace(stem(c), r"^test_", ""), r"(_test|\.test|\.spec)$", "")
    s = seeds.select(F.col("path").alias("seed"), stem("path").alias("__k"))
    t = files.where("kind = 'test'").select("path", bare("path").alias("__k"))
    return s.join(t, "__k").where("seed <> path").select("seed", "path")


def change_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """AG-3: added, changed, unchanged, removed and all files of two manifests (path, content_hash, kind)."""
    a, b = old.select("path", F.struct("content_hash", "kind").alias("o")), new.select("path", F.struct("content_hash", "kind").alias("n"))
    both = a.join(b, "path", "full_outer")
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o") != F.col("n"))).alias("changed"), F.count_if(F.col("o") == F.col("n")).alias("unchanged"), F.count_if(F.col("n").isNull()).alias("removed"), F.count("n").alias("total"))


def folder_digest(contents: DataFrame) -> DataFrame:
    """VC-7: one digest of files (path, content) in the order of their paths; digests are folded, not contents."""
    each = contents.select("path", F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: F.concat_ws(" ", x["path"], x["d"])), "\n").cast("binary"), 256).alias("digest"))
