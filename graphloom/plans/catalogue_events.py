"""Registered queries of session analytics, evaluation and classification, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.scalar import squeezed
from graphloom.operators import evaluate as V
from graphloom.operators import logs as L
from graphloom.plans import star
from graphloom.plans.catalogue import _EDGES, query
from graphloom.plans.star import table
from graphloom.sources.classify import kind_of, looks_generated

_K = "(props ->> '$.k')::BIGINT"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, count(*) AS n_events FROM events GROUP BY user_id")
def session_first_last(spark, sf_dir):
    """WN-3"""
    return L.first_last(_events(spark, sf_dir), "user_id", "event_id", "event_type")


@query(f"""WITH o AS (SELECT user_id, floor(value / 10) AS m, max({_K}) AS k, max(value) AS value FROM events GROUP BY ALL)
SELECT user_id, sum(k)::BIGINT AS k, round(sum(value), 4) AS value, count(k) AS k_known, count(value) AS value_known, count(*) AS n_messages FROM o GROUP BY user_id""")
def call_dedup_max_sum(spark, sf_dir):
    """AG-6: repeated snapshots of a message count once."""
    e = _events(spark, sf_dir).withColumn("m", F.floor(F.col("value") / 10))
    return L.deduplicated_sum(e, "user_id", "m", ["k", "value"]).withColumn("value", F.round("value", 4))


@query(f"""WITH l AS (SELECT user_id, event_id, {_K} AS k, value, {_K} < lag({_K}) OVER (PARTITION BY user_id ORDER BY event_id) AS fell FROM events)
SELECT user_id, arg_max(k, event_id) AS k, arg_max(value, event_id) AS value, sum(coalesce(fell::BIGINT, 0))::BIGINT AS n_resets FROM l GROUP BY user_id""")
def cumulative_last(spark, sf_dir):
    """AG-7, WN-4: the last snapshot, and counter resets."""
    return L.cumulative_last(_events(spark, sf_dir), "user_id", "event_id", ["k", "value"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def events_ledger_ring(spark, sf_dir):
    """SRC-14, SM-8: a ring of the last 500 events."""
    return L.ring(table(spark, sf_dir, "events"), "event_id", 500).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) = 1")
def latest_phase(spark, sf_dir):
    """AG-12: one row a key, the preferred phase first."""
    return L.latest_phase(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "purchase").select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id) FILTER (event_type = 'click') > coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) AND max(event_id) FILTER (event_type = 'click') IS NOT NULL AS unchecked_edits FROM events GROUP BY user_id".replace("SELECT user_id, max", "SELECT user_id, coalesce(max").replace("IS NOT NULL AS", "IS NOT NULL, false) AS"))
def edits_after_check(spark, sf_dir):
    """WN-5"""
    return L.after_last(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def tool_counter(spark, sf_dir):
    """AG-8: a sorted counter."""
    t = L.tally(table(spark, sf_dir, "events"), "user_id", "event_type")
    return t.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("counts"))


@query(f"SELECT event_type, count(*) AS requests, sum(CASE WHEN {_K} % 3 <> 0 THEN {_K} END)::BIGINT AS k, count(CASE WHEN {_K} % 3 <> 0 THEN 1 END) AS k_known FROM events GROUP BY event_type")
def known_counts(spark, sf_dir):
    """AG-9: what is missing never counts as zero."""
    e = _events(spark, sf_dir).withColumn("k", F.when(F.col("k") % 3 != 0, F.col("k")))
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.sum("k").alias("k"), F.count("k").alias("k_known"))


@query("""SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(median(o_totalprice), 2) AS median_o_totalprice, 0::BIGINT AS missing_o_totalprice, round(median(o_totalprice) FILTER (o_orderpriority LIKE '1%'), 2) AS median_passed_o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def cohort_medians(spark, sf_dir):
    """AG-10/11"""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = L.cohorts(o, ["c_mktsegment", "o_orderstatus"], ["o_totalprice"], F.col("o_orderpriority").startswith("1"))
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.startswith("median")})


@query("SELECT user_id, min(event_type) AS name, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id")
def call_registry(spark, sf_dir):
    """LG-2"""
    return L.calls(table(spark, sf_dir, "events"), "user_id", "event_type", "event_type").withColumn("sources", F.array_join("sources", ","))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def latest_turn_by_role(spark, sf_dir):
    """WN-7"""
    return L.latest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn").desc()]).select("conv_id", "turn", "role")


@query("SELECT l.conv_id, l.turn, round(sum(len(m.text)) / 4) AS tokens FROM conversations l JOIN conversations m ON l.conv_id = m.conv_id AND m.turn <= l.turn GROUP BY ALL")
def running_prefix_budget(spark, sf_dir):
    """WN-8, EV-32: running size of a conversation in estimated tokens."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.sum(F.length("text")).over(w) / 4).alias("tokens"))


# -- evaluation ---------------------------------------------------------------


@query("""WITH j AS (SELECT d.source, d.doc_id, l.quality, d.n_chars > 800 AS hit FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT source, count(*) FILTER (quality = 1 AND hit) AS tp, count(*) FILTER (quality <> 1 AND hit) AS fp, count(*) FILTER (quality = 1 AND NOT hit) AS fn FROM j WHERE quality = 1 OR hit GROUP BY source)
SELECT source, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM g""")
def precision_recall_by_label(spark, sf_dir):
    """AG-13, ST-2: long documents as a guess of quality."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return V.scores(j.where("quality = 1"), j.where("n_chars > 800"), ["doc_id"], ["source"])


_ORACLE = "truth AS (SELECT s, t, r FROM e WHERE (r = 'CALLS' AND t IN (SELECT 'part::' || p_partkey FROM part WHERE p_size > 10)) OR r = 'INHERITS')"


@query(f"""WITH {_EDGES}, {_ORACLE}, j AS (SELECT e.*, truth.s IS NOT NULL AS hit FROM e LEFT JOIN truth USING (s, t, r))
SELECT r AS relation, status AS resolution_status, tier AS resolution_tier, count(*) AS n, count(*) FILTER (hit) AS tp, round(count(*) FILTER (hit) / count(*), 4) AS precision FROM j GROUP BY GROUPING SETS ((r, status, tier), (r, status), (r))""")
def tier_precision(spark, sf_dir):
    """AG-14, EV-16, with totals as grouping sets."""
    return V.tier_precision(*_judged(spark, sf_dir))


def _judged(spark, sf_dir):
    e = star.published(spark, sf_dir)
    big = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("target_key"))
    return e, e.where("relation = 'CALLS'").join(big, "target_key", "left_semi").unionByName(e.where("relation = 'INHERITS'"))


@query(f"""WITH {_EDGES}, {_ORACLE}, j AS (SELECT e.*, truth.s IS NOT NULL AS hit FROM e LEFT JOIN truth USING (s, t, r)),
p AS (SELECT r, status, tier, round(count(*) FILTER (hit) / count(*), 4) AS p FROM j GROUP BY GROUPING SETS ((r, status, tier), (r, status), (r)))
SELECT r AS relation, coalesce(max(p) FILTER (tier IS NULL AND status = 'resolved') >= 0.95, true) AS overall, coalesce(max(p) FILTER (tier = 'import_map') >= 0.99, true) AS import_map, coalesce(max(p) FILTER (tier = 'same_module') >= 0.99, true) AS same_module, coalesce(max(p) FILTER (tier = 'inherited') >= 0.99, true) AS inherited FROM p GROUP BY r""")
def tier_thresholds(spark, sf_dir):
    """EV-26"""
    return V.thresholds(V.tier_precision(*_judged(spark, sf_dir)))


@query(f"""WITH {_EDGES}, run AS (SELECT 'orders::' || l_orderkey AS s, 'part::' || l_partkey AS t, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
st AS (SELECT s, t, max(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS k FROM e WHERE r = 'CALLS' AND t NOT LIKE '%7' GROUP BY s, t)
SELECT CASE k WHEN 1 THEN 'resolved' WHEN 0 THEN 'candidate_only' ELSE 'absent' END AS part, count(*) AS n_edges, sum(n)::BIGINT AS n_calls FROM run LEFT JOIN st USING (s, t) GROUP BY 1""")
def runtime_accounting(spark, sf_dir):
    """AG-23, EV-19: every runtime edge is in one part."""
    run = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.concat(F.lit("orders::"), F.col("l_orderkey").cast("string")).alias("source_key"), F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("target_key")).agg(F.count("*").alias("count"))
    return V.accounted(run, star.published(spark, sf_dir).where("relation = 'CALLS' AND target_key NOT LIKE '%7'"))


_TASKS = "t AS (SELECT DISTINCT n_regionkey AS lang, n_nationkey AS repo, c_mktsegment AS stratum, c_custkey AS task FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {_TASKS}, a AS (SELECT lang, count(DISTINCT repo) AS nr FROM t GROUP BY 1), b AS (SELECT lang, repo, count(DISTINCT stratum) AS ns FROM t GROUP BY 1, 2), c AS (SELECT lang, repo, stratum, count(DISTINCT task) AS nt FROM t GROUP BY 1, 2, 3)
SELECT task, round(1.0 / ((SELECT count(DISTINCT lang) FROM t) * nr * ns * nt), 9) AS weight FROM t JOIN a USING (lang) JOIN b USING (lang, repo) JOIN c USING (lang, repo, stratum)""")
def hierarchical_weights(spark, sf_dir):
    """AG-15"""
    return V.weights(_tasks(spark, sf_dir)).select("task", F.round("weight", 9).alias("weight"))


def _tasks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_regionkey").alias("lang"), F.col("n_nationkey").alias("repo"), F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("task")).distinct()


@query("""WITH o AS (SELECT o_custkey AS task, o_orderstatus AS condition, median(o_totalprice) AS m FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL), w AS (SELECT task, max(m) FILTER (condition = 'F') AS f, max(m) FILTER (condition = 'O') AS o FROM o GROUP BY task HAVING count(*) = 2)
SELECT round(sum(1.0 / (1 + task % 5) * f) / sum(1.0 / (1 + task % 5) * o), 4) AS ratio, count(*) AS n_tasks FROM w""")
def weighted_median_ratio(spark, sf_dir):
    """AG-16: customers with orders of both conditions as tasks."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("condition"), "o_totalprice")
    both = o.groupBy("task").agg(F.countDistinct("condition").alias("n")).where("n = 2").select("task", (1.0 / (1 + F.col("task") % 5)).alias("weight"))
    return V.weighted_median_ratio(o, both, "o_totalprice", "F", "O")


_RANKED = "ranked AS (SELECT o_custkey AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), relevant AS (SELECT o_custkey AS q, o_orderkey AS item, c_mktsegment AS category FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%')"


@query(f"""WITH {_RANKED}, p AS (SELECT q, category, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS recall FROM relevant JOIN ranked USING (q, item) GROUP BY ALL)
SELECT category, round(avg(recall), 4) AS recall, count(*) AS n_queries FROM p GROUP BY category UNION ALL SELECT 'all', round(avg(recall), 4), count(*) FROM p""")
def recall_at_5(spark, sf_dir):
    """AG-18, EV-22"""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    ranked = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("rank"))
    rel = o.where("o_orderpriority LIKE '1%'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.col("c_mktsegment").alias("category"))
    return V.recall_at(ranked, rel, "category")


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95, median(o_totalprice) AS p50, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def p95_nearest_rank(spark, sf_dir):
    """AG-19"""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice)").alias("p95"), F.median("o_totalprice").alias("p50"), F.max("o_totalprice").alias("largest"))


_STATUS = "CASE WHEN len(text) % 5 = 0 THEN 'failed' WHEN len(text) % 7 = 0 THEN 'not_evaluated' ELSE 'passed' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_STATUS} AS status FROM conversations), g AS (SELECT conv_id, count(*) AS k, bool_and(status <> 'not_evaluated') AS w, arg_min(status = 'passed', turn) AS a, bool_or(status = 'passed') AS b, bool_and(status = 'passed') AS c, avg((status = 'passed')::INT) AS d FROM r GROUP BY conv_id)
SELECT conv_id, k, CASE WHEN w THEN a END AS pass_at_1, CASE WHEN w THEN b END AS pass_at_k, CASE WHEN w THEN c END AS pass_hat_k, CASE WHEN w THEN round(d, 4) END AS pass_rate FROM g""")
def pass_at_k(spark, sf_dir):
    """AG-20, EV-11/13"""
    r = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("run"), V.verdict(F.length("text") % 5 == 0, F.length("text") % 7 != 0).alias("status"))
    return V.repeatability(r, ["conv_id"])


@query(f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM conversations) GROUP BY 1")
def verdict_tristate(spark, sf_dir):
    """EV-11, AG-22"""
    r = table(spark, sf_dir, "conversations").select(V.verdict(F.length("text") % 5 == 0, F.length("text") % 7 != 0).alias("status"))
    return r.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, arg_min(o_orderkey, sha256('seed7:' || o_orderstatus || ':' || o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def seeded_pick(spark, sf_dir):
    """TK-7"""
    return V.seeded_pick(table(spark, sf_dir, "orders"), "seed7", ["o_orderstatus"], "o_orderkey")


@query("""WITH x AS (SELECT n_nationkey AS task, c AS condition, r::INT AS repeat FROM nation, (VALUES ('baseline'), ('treatment')) a(c), range(1, 4) b(r))
SELECT *, row_number() OVER (ORDER BY sha256('seed7:' || task || ':' || condition || ':' || repeat))::INT AS place FROM x""")
def seeded_schedule(spark, sf_dir):
    """TK-8"""
    return V.schedule(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task")), ["baseline", "treatment"], 3, "seed7")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) = 1")
def terminal_attempt(spark, sf_dir):
    """WN-10"""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return V.terminal(o, ["o_custkey"], "ok", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT round(sum(CASE WHEN event_type = 'error' THEN 25.0 ELSE value END), 4) AS committed, count(*) FILTER (event_type = 'error') AS unknown FROM events")
def committed_spend(spark, sf_dir):
    """AG-27"""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("cost_usd"))
    return V.committed_spend(e, 25.0).withColumn("committed", F.round("committed", 4))


@query("SELECT user_id, event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_success FROM events WHERE event_type IN ('error', 'purchase') QUALIFY event_type = 'error'")
def recovery_window(spark, sf_dir):
    """WN-9, EV-10: the first success behind each failure."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(1, W.unboundedFollowing)
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return e.withColumn("next_success", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)).where("event_type = 'error'").select("user_id", "event_id", "next_success")


# -- ranges and classification ------------------------------------------------


@query("""WITH b AS (SELECT user_id, event_id AS first, event_id + 400 AS last FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, arg_min(b.first, (b.last - b.first, -b.first)) AS owner FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id BETWEEN b.first AND b.last GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY e.event_id, e.user_id"))
def symbol_owner_range(spark, sf_dir):
    """JN-5, RES-8: the innermost range that holds an event; of equal ones the later."""
    from graphloom.operators.resolve import innermost

    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + 400).alias("last"), F.col("event_id").alias("owner"))
    return innermost(e.select("event_id", "user_id"), spans, ["user_id"], "event_id", "owner").where("owner IS NOT NULL")


_PATH = r"regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@query(rf"""WITH u AS (SELECT page_id, {_PATH} AS p FROM pages), v AS (SELECT *, string_split(p, '/') AS parts, lower(regexp_extract(p, '[^/]*$')) AS name FROM u)
SELECT page_id, CASE WHEN list_has_any(list_transform(parts[1:-2], lambda x: lower(x)), ['test', 'tests', '__tests__', 'spec']) OR contains(name, 'test_') OR contains(name, '_test.') OR contains(name, '.test.') OR contains(name, '.spec.') THEN 'test'
  WHEN regexp_matches(name, '.[.](toml|yaml|yml|json|ini|cfg|env)$') THEN 'config' WHEN regexp_matches(name, '.[.](md|rst|txt|adoc)$') OR list_has_any(list_transform(parts[1:-2], lambda x: lower(x)), ['docs', 'doc']) THEN 'doc'
  WHEN regexp_matches(name, '.[.](py|js|jsx|ts|tsx|go|rs|java|c|h|cpp|hpp|rb|php|cs|swift|kt|scala|sh)$') THEN 'source' ELSE 'other' END AS kind FROM v""")
def classify_paths(spark, sf_dir):
    """SRC-4"""
    return table(spark, sf_dir, "pages").select("page_id", kind_of(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)).alias("kind"))


@query(r"SELECT page_id, regexp_matches(lower(html[1:1024]), '@generated|do not edit|code generated by|auto-?generated (by|using|with)\b') OR (strlen(html) >= 1500 AND strlen(html) / (len(html) - len(replace(html, chr(10), '')) + 1) > 200) AS generated FROM pages")
def generated_banner(spark, sf_dir):
    """SRC-5"""
    return table(spark, sf_dir, "pages").select("page_id", looks_generated(F.col("html").cast("binary")).alias("generated"))


@query(r"SELECT item_id, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS text FROM benchmark")
def squeezed_text(spark, sf_dir):
    """2.14: white space and case aside."""
    return table(spark, sf_dir, "benchmark").select("item_id", squeezed("text").alias("text"))
