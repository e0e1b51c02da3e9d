"""Evaluation: set metrics, tiers, medians, recall, repeatability, verdicts (AG-13 to AG-27, EV-11 to EV-13, EV-15 to EV-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Thresholds of the population gate.
PRECISION, TIER_PRECISION, RECALL = 0.95, 0.99, 0.90


def ratio(a: Column, b: Column) -> Column:
    """Four places; null where the denominator is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)


def scores(expected: DataFrame, actual: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """AG-13: tp, fp, fn, precision and recall of two sets of keys, a group or one row."""
    by = by or []
    a = expected.select(*by, *key).distinct().withColumn("__e", F.lit(True))
    b = actual.select(*by, *key).distinct().withColumn("__a", F.lit(True))
    both = a.join(b, [*by, *key], "full_outer")
    out = both.groupBy(*by).agg(F.count_if(F.col("__e").isNotNull() & F.col("__a").isNotNull()).alias("tp"), F.count_if(F.col("__e").isNull()).alias("fp"), F.count_if(F.col("__a").isNull()).alias("fn"))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def tier_precision(edges: DataFrame, oracle: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """AG-14, EV-16: precision by relation, status and tier with totals; adjudicated edges count by their verdict."""
    key = ["source_key", "target_key", "relation"]
    e = edges.join(oracle.select(*key).withColumn("__hit", F.lit(True)), key, "left")
    if adjudications is not None:
        e = e.join(adjudications.select(*key, "verdict"), key, "left")
        e = e.withColumn("__hit", F.coalesce(F.when(F.col("verdict") == "true", True).when(F.col("verdict") == "false", False), F.col("__hit")))
    e.createOrReplaceTempView("__tier_precision")
    return e.sparkSession.sql("""SELECT relation, resolution_status, resolution_tier, count(*) AS n, count_if(coalesce(__hit, false)) AS tp, round(try_divide(count_if(coalesce(__hit, false)), count(*)), 4) AS precision
        FROM __tier_precision GROUP BY GROUPING SETS ((relation, resolution_status, resolution_tier), (relation, resolution_status), (relation))""")


def thresholds(tiers: DataFrame) -> DataFrame:
    """EV-26: whether each relation's precisions reach their bounds; a tier that is missing passes."""
    pick = lambda t: F.max(F.when(F.col("resolution_tier") == t, F.col("precision")))
    total = F.max(F.when(F.col("resolution_tier").isNull() & (F.col("resolution_status") == "resolved"), F.col("precision")))
    ok = lambda c, t: F.coalesce(c >= t, F.lit(True))
    return tiers.groupBy("relation").agg(ok(total, PRECISION).alias("overall"), *[ok(pick(t), TIER_PRECISION).alias(t) for t in ("import_map", "same_module", "inherited")])


def mapped(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """JN-15: their symbols to ours (file, qualname, id): by exact name, else by a last segment that is unique in its file."""
    a = theirs.select(F.col("id").alias("their_id"), "file", "qualname", F.substring_index("qualname", ".", -1).alias("last"))
    exact = ours.select(F.col("id").alias("exact_id"), "file", "qualname")
    one = ours.groupBy("file", F.substring_index("qualname", ".", -1).alias("last")).agg(F.count("*").alias("n"), F.min("id").alias("near_id")).where("n = 1").drop("n")
    out = a.join(exact, ["file", "qualname"], "left").join(one, ["file", "last"], "left")
    return out.select("their_id", F.coalesce("exact_id", "near_id").alias("our_id"), F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "unique").otherwise("unmapped").alias("mapping"))


def compare_pairs(theirs: DataFrame, ours: DataFrame, their_symbols: DataFrame, our_symbols: DataFrame) -> DataFrame:
    """EV-15: one row: pairs of symbols that both graphs, only ours or only theirs connect, and their pairs that map to none of ours."""
    m = mapped(their_symbols, our_symbols).select("their_id", "our_id")
    pair = theirs.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    pair = pair.join(m.withColumnsRenamed({"their_id": "s", "our_id": "source"}), "s", "left").join(m.withColumnsRenamed({"their_id": "t", "our_id": "target"}), "t", "left")
    found = scores(pair.where("source IS NOT NULL AND target IS NOT NULL"), ours, ["source", "target"])
    lost = pair.where("source IS NULL OR target IS NULL").agg(F.count("*").alias("unmapped"))
    return found.join(lost)


def unused_claims(symbols: DataFrame, ours: DataFrame, oracle: DataFrame, candidates: bool = False) -> DataFrame:
    """EV-18: one row: symbols (id) that no edge (source, target, resolution_status) uses, and how many of them the oracle
    (source, target, basis) finds used, by a binding or by declared types alone."""
    used = ours.where("source <> target") if candidates else ours.where("source <> target AND resolution_status = 'resolved'")
    claims = symbols.select("id").join(used.select(F.col("target").alias("id")), "id", "left_anti")
    found = oracle.where("source <> target").groupBy(F.col("target").alias("id")).agg(F.bool_or(F.col("basis") == "binding").alias("bound"))
    out = claims.join(found, "id", "left").agg(F.count("*").alias("claims"), F.count("bound").alias("wrong"), F.count_if("bound").alias("bound"))
    return out.withColumn("false_claim_rate", ratio(F.col("wrong"), F.col("claims"))).withColumn("type_declared_only", F.col("wrong") - F.col("bound"))


def hard_cases(ours: DataFrame, oracle: DataFrame, hard: Column) -> DataFrame:
    """EV-18: of the pairs for which `hard` holds (a condition on source and target): precision by status, and the recall of
    what the oracle supports by more than declared types; one row."""
    a = ours.groupBy("source", "target").agg(F.bool_or(F.col("resolution_status") == "resolved").alias("r"), F.bool_or(F.col("resolution_status") == "candidate").alias("c"))
    b = oracle.groupBy("source", "target").agg(F.bool_or(F.col("basis") != "type_declared").alias("supported"))
    both = a.join(b, ["source", "target"], "full_outer").where(hard)
    r, c, s = (F.coalesce(F.col(x), F.lit(False)) for x in ("r", "c", "supported"))
    in_oracle = F.col("supported").isNotNull()
    out = both.agg(
        F.count_if(r).alias("resolved_edges"), F.count_if(r & in_oracle).alias("resolved_tp"), F.count_if(c).alias("candidate_edges"), F.count_if(c & in_oracle).alias("candidate_tp"), F.count_if(in_oracle).alias("oracle_edges"),
        F.count_if(s).alias("supported"), F.count_if(s & r).alias("__hit"), F.count_if(s & ~r & c).alias("missed_but_candidate"), F.count_if(s & ~r & ~c).alias("missed_entirely"),
    )
    out = out.withColumn("resolved_precision", ratio(F.col("resolved_tp"), F.col("resolved_edges"))).withColumn("candidate_precision", ratio(F.col("candidate_tp"), F.col("candidate_edges")))
    return out.withColumn("supported_recall", ratio(F.col("__hit"), F.col("supported"))).drop("__hit")


#: EV-23: what a record of an adjudicated edge has, and its verdicts. Who finds them is no part of this engine.
ADJUDICATION, VERDICTS = "repo_sha string, source_key string, target_key string, relation string, verdict string, category string", ("true", "false", "unclear")


def adjudicated(records: DataFrame) -> DataFrame:
    """EV-23: records of known verdicts, one an edge; edges with two verdicts are unclear."""
    known = records.where(F.col("verdict").isin(*VERDICTS))
    one = known.groupBy("repo_sha", "source_key", "target_key", "relation").agg(F.countDistinct("verdict").alias("n"), F.min("verdict").alias("verdict"), F.min("category").alias("category"))
    return one.withColumn("verdict", F.when(F.col("n") > 1, "unclear").otherwise(F.col("verdict"))).drop("n")


def weights(tasks: DataFrame) -> DataFrame:
    """AG-15: 1 / (languages * repositories of the language * strata of the repository * tasks of the stratum)."""
    size = lambda c, *by: F.size(F.collect_set(c).over(W.partitionBy(*by)))
    return tasks.withColumn("weight", 1.0 / (size("lang") * size("repo", "lang") * size("stratum", "lang", "repo") * size("task", "lang", "repo", "stratum")))


def weighted_median_ratio(attempts: DataFrame, weighted: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """AG-16: sum of w * median under a over that under b; null if a cell is missing."""
    med = attempts.groupBy("task", "condition").agg(F.median(value).alias("m"))
    wide = weighted.select("task", "weight").join(med.groupBy("task").pivot("condition", [a, b]).agg(F.first("m")), "task", "left")
    whole = F.bool_and(F.col(a).isNotNull() & F.col(b).isNotNull())
    return wide.agg(F.when(whole, F.round(F.sum(F.col("weight") * F.col(a)) / F.sum(F.col("weight") * F.col(b)), 4)).alias("ratio"), F.count("*").alias("n_tasks"))


def terminal(attempts: DataFrame, keys: list[str], ok: str, order: str) -> DataFrame:
    """WN-10: the last attempt that is ok, else the last."""
    w = W.partitionBy(*keys).orderBy(F.col(ok).desc(), F.col(order).desc())
    return attempts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def recall_at(ranked: DataFrame, relevant: DataFrame, by: str, k: int = 5) -> DataFrame:
    """AG-18: the share of relevant items in each query's first k, averaged by category and over all."""
    hit = relevant.join(ranked.where(F.col("rank") <= k).select("query_id", "item"), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    per = relevant.groupBy("query_id", by).agg(F.count("*").alias("n")).join(hit, "query_id", "left").withColumn("recall", F.coalesce("hits", F.lit(0)) / F.col("n"))
    each = per.groupBy(by).agg(F.round(F.avg("recall"), 4).alias("recall"), F.count("*").alias("n_queries"))
    return each.union(per.agg(F.lit("all"), F.round(F.avg("recall"), 4), F.count("*")))


def repeatability(runs: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """AG-20: pass@1, pass@k, pass^k and rate; null unless every run is evaluated."""
    whole, passed = F.bool_and(F.col(status) != "not_evaluated"), F.col(status) == "passed"
    out = runs.groupBy(*keys).agg(F.count("*").alias("k"), whole.alias("__w"), F.min_by(passed, "run").alias("p1"), F.bool_or(passed).alias("any"), F.bool_and(passed).alias("all"), F.avg(passed.cast("double")).alias("rate"))
    return out.select(*keys, "k", *[F.when(F.col("__w"), F.col(c)).alias(n) for c, n in (("p1", "pass_at_1"), ("any", "pass_at_k"), ("all", "pass_hat_k"))], F.when(F.col("__w"), F.round("rate", 4)).alias("pass_rate"))


def verdict(failed: Column, complete: Column) -> Column:
    """EV-11: failed if any check fails; else not_evaluated if incomplete; else passed."""
    return F.when(failed, "failed").when(~complete, "not_evaluated").otherwise("passed")


def admission(measured: Column, bound: float) -> Column:
    """EV-24: what was not measured is UNKNOWN and never PASS."""
    return F.when(measured.isNull(), "UNKNOWN").when(measured >= bound, "PASS").otherwise("FAIL")


def retryable(crashed: Column, output_bytes: Column) -> Column:
    """EV-25: only a crash before any output."""
    return crashed & (output_bytes == 0)


def committed_spend(attempts: DataFrame, cap: float) -> DataFrame:
    """AG-27: known costs, and the cap for unknown ones."""
    return attempts.agg(F.sum(F.coalesce("cost_usd", F.lit(cap))).alias("committed"), F.count_if(F.col("cost_usd").isNull()).alias("unknown"))


def accounted(runtime: DataFrame, static: DataFrame) -> DataFrame:
    """AG-23, EV-19: runtime edges that are resolved, only candidate, or absent, with counts; classes of a call to
    X.__init__ are hit by an edge to X (GR-17)."""
    to = F.regexp_replace("target_key", r"\.__init__$", "")
    s = static.groupBy("source_key", to.alias("__t")).agg(F.max((F.col("resolution_status") == "resolved").cast("int")).alias("__r"))
    j = runtime.withColumn("__t", to).join(s, ["source_key", "__t"], "left")
    part = F.when(F.col("__r") == 1, "resolved").when(F.col("__r") == 0, "candidate_only").otherwise("absent")
    return j.groupBy(part.alias("part")).agg(F.count("*").alias("n_edges"), F.sum("count").alias("n_calls"))


def seeded_pick(rows: DataFrame, seed: str, group: list[str], key: str) -> DataFrame:
    """TK-7: of each group the key with the smallest sha-256 of seed:group:key."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(key).cast("string")).cast("binary"), 256)
    return rows.groupBy(*group).agg(F.min_by(key, h).alias(key))


def schedule(tasks: DataFrame, conditions: list[str], repeats: int, seed: str) -> DataFrame:
    """TK-8: every task, condition and repeat in a seeded order. A schedule is as long as its author asks for."""
    each = tasks.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions]))).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("task").cast("string"), "condition", F.col("repeat").cast("string")).cast("binary"), 256)
    return each.withColumn("place", F.row_number().over(W.orderBy(h)))


def manifest_filter(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EV-28: symbols of the files, and edges whose two ends are among them."""
    keep = symbols.join(files.select("file"), "file", "left_semi")
    ids = keep.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return keep, out


def grade(answers: DataFrame) -> DataFrame:
    """EV-20: expected and actual arrays as sets; or an accepted path."""
    return answers.withColumn("missing", F.size(F.array_except("expected", "actual"))).withColumn("extra", F.size(F.array_except("actual", "expected"))).withColumn("correct", F.expr("missing = 0 AND extra = 0"))
