"""Registered queries of reports, manifests and set operations, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import logs
from graphloom.operators import reports as R
from graphloom.plans import star
from graphloom.plans.catalogue import _EDGES, query
from graphloom.plans.catalogue_code import _TYPED, _typed
from graphloom.plans.star import table


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(lower(text), '\b(fix|bug|error|fail)') THEN 'fix' END, CASE WHEN regexp_matches(lower(text), '\b(add|implement|feature)') THEN 'feature' END, CASE WHEN regexp_matches(lower(text), '\b(refactor|rename|clean)') THEN 'refactor' END,
CASE WHEN regexp_matches(lower(text), '\b(test|coverage)') THEN 'test' END, CASE WHEN regexp_matches(lower(text), '\b(explain|why|how|what)') THEN 'explain' END], lambda x: x IS NOT NULL)), ',') AS activities FROM conversations WHERE role = 'user'""")
def task_activities(spark, sf_dir):
    """LG-6"""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(R.activities("text"), ",").alias("activities"))


@query(f"""WITH {_TYPED}, r AS (SELECT session, count(*) FILTER (ok) AS p, count(*) FILTER (NOT ok) AS f FROM (SELECT DISTINCT session, c FROM t WHERE kind = 'call') LEFT JOIN (SELECT session, c, max(ok) AS ok FROM t WHERE kind = 'result' GROUP BY 1, 2) USING (session, c) GROUP BY 1)
SELECT s.session, CASE WHEN r.session IS NULL THEN 'unknown' WHEN f = 0 THEN 'passed' WHEN p = 0 THEN 'failed' ELSE 'mixed' END AS checks FROM (SELECT DISTINCT session FROM t) s LEFT JOIN r USING (session)""")
def session_assessments(spark, sf_dir):
    """LG-8"""
    return R.assessments(logs.session_reports(_typed(table(spark, sf_dir, "events")))).select("session", "checks")


_ATT = "a AS (SELECT o_custkey AS task, o_orderstatus AS condition, o_totalprice AS tokens, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS correct, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 END AS cost FROM orders)"


def _attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").like("2%")
    return o.select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("condition"), F.col("o_totalprice").alias("tokens"), ok.alias("correct"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 1000).alias("cost_usd"))


@query(f"WITH {_ATT} SELECT condition, count(*) AS n, round(avg(tokens), 4) AS mean_tokens, median(tokens) AS median_tokens, round(avg(correct::INT), 4) AS correct_rate, round(sum(cost), 4) AS cost_usd, count(*) FILTER (cost IS NULL) AS cost_unknown FROM a GROUP BY 1")
def condition_summary(spark, sf_dir):
    """AG-17"""
    return R.conditions(_attempts(spark, sf_dir), ["condition"])


@query(f"WITH {_ATT}, s AS (SELECT task, median(tokens) FILTER (condition = 'F') / median(tokens) FILTER (condition = 'O') AS r, avg(correct::INT) FILTER (condition = 'F') AS b, avg(correct::INT) FILTER (condition = 'O') AS t FROM a GROUP BY task) SELECT CASE WHEN r IS NULL OR b IS NULL OR t IS NULL THEN 'INCOMPLETE' WHEN r >= 1.25 AND t >= b THEN 'GO' ELSE 'STOP' END AS verdict, count(*) AS n FROM s GROUP BY 1")
def ab_verdicts(spark, sf_dir):
    """EV-21"""
    a = _attempts(spark, sf_dir)
    m = lambda c, v: F.median(F.when(F.col("condition") == c, F.col(v)))
    avg = lambda c: F.avg(F.when(F.col("condition") == c, F.col("correct").cast("double")))
    s = a.groupBy("task").agg(F.try_divide(m("F", "tokens"), m("O", "tokens")).alias("token_ratio"), avg("F").alias("correct_baseline"), avg("O").alias("correct_treatment"))
    return R.verdict(s).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(DISTINCT role) AS variants, round(avg((len(text) > 50)::INT), 4) AS valid_rate, round(avg((len(text) % 2 = 0)::INT), 4) AS pass_rate FROM conversations GROUP BY 1")
def robustness_groups(spark, sf_dir):
    """AG-21"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.length("text") > 50).alias("valid"), (F.length("text") % 2 == 0).alias("passed"))
    return R.robustness(c, "conv_id", "role")


@query("SELECT CASE WHEN regexp_matches(url, '/de/') THEN 'german' WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '#') THEN 'fragment' ELSE 'other' END AS category, count(*) AS n FROM pages GROUP BY 1")
def miss_categories(spark, sf_dir):
    """EV-17"""
    return R.miss_categories(table(spark, sf_dir, "pages"), "url", {"german": "/de/", "query": "[?]", "fragment": "#"})


@query("SELECT reason, included, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS reason, NOT coalesce(n_chars < 100 OR lang <> 'en', false) AS included FROM documents) GROUP BY ALL")
def manifest_counts(spark, sf_dir):
    """EV-29"""
    m = R.manifest(table(spark, sf_dir, "documents"), [("short", F.col("n_chars") < 100), ("language", F.col("lang") != "en")])
    return m.groupBy("reason", "included").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT l_returnflag AS relation, l_linestatus AS verdict, l_orderkey AS id FROM lineitem WHERE l_linenumber <= 2 UNION SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem WHERE l_linenumber >= 2) SELECT relation, verdict, count(*) AS n FROM r GROUP BY ALL")
def adjudication_union(spark, sf_dir):
    """EV-30, ST-1"""
    li = table(spark, sf_dir, "lineitem")
    cols = [F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("verdict"), F.col("l_orderkey").alias("id")]
    return R.verdicts(li.where("l_linenumber <= 2").select(*cols), li.where("l_linenumber >= 2").select(*cols))


@query(f"""WITH {_EDGES}, x AS (SELECT s, split_part(s, '::', 2)::BIGINT % 20 AS sf, t, split_part(t, '::', 2)::BIGINT % 20 AS tf FROM e WHERE r = 'CALLS' AND split_part(s, '::', 2)::BIGINT % 20 <> split_part(t, '::', 2)::BIGINT % 20)
SELECT 'called from files' AS structure, count(*) AS n FROM (SELECT t FROM x GROUP BY t HAVING count(DISTINCT sf) >= 3) UNION ALL SELECT 'calls foreign symbols', count(*) FROM (SELECT s FROM x GROUP BY s HAVING count(DISTINCT t) >= 3)""")
def structural_admission(spark, sf_dir):
    """EV-31"""
    file = lambda c: (F.substring_index(c, "::", -1).cast("long") % 20).alias(c.replace("key", "file"))
    e = star.published(spark, sf_dir).where("relation = 'CALLS'").select("source_key", file("source_key"), "target_key", file("target_key"))
    return R.admission(e)


@query("SELECT conv_id, baseline_tokens, our_tokens, CASE WHEN our_tokens > 0 THEN round(baseline_tokens / our_tokens, 4) END AS ratio FROM (SELECT conv_id, round(sum(len(text)) / 4)::BIGINT AS baseline_tokens, round(max(CASE WHEN role = 'user' THEN len(text) ELSE 0 END) / 4)::BIGINT AS our_tokens FROM conversations GROUP BY 1)")
def response_size_ratio(spark, sf_dir):
    """EV-32: a whole conversation against its longest user turn."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(R.tokens(F.sum(F.length("text"))).alias("baseline_tokens"), R.tokens(F.max(F.when(F.col("role") == "user", F.length("text")).otherwise(0))).alias("our_tokens"))
    return c.withColumn("ratio", R.ratio(F.col("baseline_tokens"), F.col("our_tokens")))


@query("WITH n AS (SELECT DISTINCT user_id AS session, event_id % 100 AS oid FROM events WHERE event_type = 'click'), l AS (SELECT DISTINCT event_id % 100 AS oid FROM events WHERE event_type = 'error' AND value > 20) SELECT session, count(*) AS observed, count(l.oid) AS linked, CASE WHEN count(*) > 0 AND count(*) = count(l.oid) THEN 'complete' ELSE 'incomplete_attribution' END AS profile FROM n LEFT JOIN l USING (oid) GROUP BY 1")
def observation_links(spark, sf_dir):
    """JN-14, LG-14"""
    e = table(spark, sf_dir, "events")
    t = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("session")).agg(F.collect_set(F.col("event_id") % 100).alias("observation_ids"))
    return logs.profile(R.linked(t, e.where("event_type = 'error' AND value > 20").select((F.col("event_id") % 100).alias("observation_id"))))


_SPAN = "s AS (SELECT p_brand AS path, p_size AS a, p_size + p_partkey % 4 AS z, p_partkey AS k FROM part)"


@query(f"WITH {_SPAN} SELECT path, a AS start_line, z AS end_line, k AS place FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.path = x.path AND y.k < x.k AND x.a <= y.z AND y.a <= x.z)")
def overlap_spans(spark, sf_dir):
    """JN-19"""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 4).alias("end_line"), F.col("p_partkey").alias("place"))
    return R.unrepeated(p)


@query(f"WITH {_SPAN}, d AS (SELECT path, a, z, array_to_string(list(n ORDER BY l, n)[1:6], ',') AS definitions, count(*) > 6 AS truncated FROM (SELECT DISTINCT path, a, z FROM s) x JOIN (SELECT p_brand AS path, p_size AS l, p_name AS n FROM part) y USING (path) WHERE l BETWEEN a AND z GROUP BY path, a, z) SELECT path, a AS start_line, z AS end_line, definitions, truncated FROM d")
def enriched_definitions(spark, sf_dir):
    """TX-7, TK-6: the first six definitions in each span."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 4).alias("end_line")).distinct()
    symbols = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))
    none = star.published(spark, sf_dir).where("false")
    return R.enriched(items, symbols, none).select("path", "start_line", "end_line", F.array_join("definitions", ",").alias("definitions"), "truncated")


@query("SELECT c_custkey, c_mktsegment, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, src) AS n, tier AS place FROM (SELECT c_custkey, c_mktsegment, 0 AS tier, 'e' AS src FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_mktsegment, 1, 'l' FROM customer WHERE c_nationkey < 12)) WHERE n = 1")
def ordered_union(spark, sf_dir):
    """ST-4: the first tier that has a key wins."""
    c = table(spark, sf_dir, "customer")
    a = c.where("c_acctbal > 5000").select("c_custkey", "c_mktsegment", F.lit(0).alias("place"))
    b = c.where("c_nationkey < 12").select("c_custkey", "c_mktsegment", F.lit(1).alias("place"))
    return a.union(b).withColumn("n", F.row_number().over(W.partitionBy("c_custkey").orderBy("place"))).where("n = 1").drop("n")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1")
def union_of_labels(spark, sf_dir):
    """ST-5: sorted unions of labels a key."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.countDistinct("o_orderstatus").alias("n_status"))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[^:]*://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[^:]*://([^/?#]*)', 1) FROM pages WHERE page_id % 10 = 0)")
def discovered_sources(spark, sf_dir):
    """SRC-13, JN-9: rows whose header names a registered source."""
    u = table(spark, sf_dir, "pages").withColumn("repo", F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1))
    return R.discovered(u, u.where("page_id % 10 = 0").select("repo").distinct()).select("page_id", "url")


@query("SELECT CAST(item_id AS VARCHAR) AS name FROM benchmark WHERE item_id % 3 = 0 AND text IS NOT NULL")
def provenance_broken(spark, sf_dir):
    """EV-27: inputs that are no longer what a summary states."""
    b = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("name"), "item_id", "text")
    stated = b.select("name", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return R.provenance(stated, b.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sum(len(regexp_extract_all(line, '\bthe ')))::BIGINT AS n FROM l WHERE NOT regexp_matches(line, '^\s*(#|//|def\s+the \b|function\s+the \b)') GROUP BY doc_id""".replace(r"\bthe '", r"\btoken\('").replace(r"def\s+the \b|function\s+the \b", r"def\s+token\b|function\s+token\b"))
def call_site_counts(spark, sf_dir):
    """TX-10: textual calls in documents."""
    return R.call_sites(table(spark, sf_dir, "documents"), "doc_id", "text", "token")


@query(f"""WITH {_TYPED}, a AS (SELECT session, arg_max(k, seq) AS total FROM t WHERE kind = 'usage' AND client = 'a' GROUP BY 1), b AS (SELECT session, sum(k) AS total FROM (SELECT session, m, max(k) AS k FROM t WHERE kind = 'usage' AND client = 'b' GROUP BY 1, 2) GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
r AS (SELECT session, count(*) AS c, count(*) FILTER (NOT ok) AS f FROM (SELECT DISTINCT session, c FROM t WHERE kind = 'call') LEFT JOIN (SELECT session, c, max(ok) AS ok FROM t WHERE kind = 'result' GROUP BY 1, 2) USING (session, c) GROUP BY 1)
SELECT (SELECT count(DISTINCT session) FROM t) AS sessions, (SELECT sum(total)::BIGINT FROM u) AS total_tokens, (SELECT count(total) FROM u) AS sessions_with_usage, (SELECT sum(c)::BIGINT FROM r) AS calls, (SELECT sum(f)::BIGINT FROM r) AS failed, (SELECT round(avg(total), 4) FROM u) AS mean_tokens""")
def dashboard_kpis(spark, sf_dir):
    """LG-17"""
    return R.kpis(logs.session_reports(_typed(table(spark, sf_dir, "events"))))


@query("""WITH o AS (SELECT event_id % 300 AS oid, user_id % 5 AS tool, event_type = 'purchase' AS done, event_id, CASE WHEN event_id % 4 <> 0 THEN (props ->> '$.k')::BIGINT END AS bytes, value FROM events WHERE event_type IN ('purchase', 'signup')),
p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY oid ORDER BY done DESC, event_id DESC) = 1)
SELECT tool, count(*) AS requests, sum(bytes)::BIGINT AS response_bytes, count(bytes) AS response_bytes_known, median(value) AS median_ms FROM p GROUP BY tool""")
def retrieval_evidence(spark, sf_dir):
    """LG-13, AG-9, AG-12: one row an observation, sums with their known counts."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    k = F.get_json_object("props", "$.k").cast("long")
    ledger = e.select(
        (F.col("event_id") % 300).alias("observation_id"), (F.col("user_id") % 5).alias("tool"), F.when(F.col("event_type") == "purchase", "completed").otherwise("invoked").alias("phase"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 4 != 0, k).alias("response_bytes"), F.lit(1).alias("result_count"), F.lit(False).alias("truncated"), F.col("value").alias("duration_ms"),
    )
    return logs.retrieval_evidence(ledger).select("tool", "requests", "response_bytes", "response_bytes_known", "median_ms")


@query("SELECT count(*) FILTER (o.p_partkey IS NULL) AS added, count(*) FILTER (o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL AND o.p_size <> n.s) AS changed, count(*) FILTER (o.p_size = n.s) AS unchanged, count(*) FILTER (n.p_partkey IS NULL) AS removed, count(n.p_partkey) AS total FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0) o FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 11 <> 0) n USING (p_partkey)")
def file_change_counts(spark, sf_dir):
    """AG-3, JN-11"""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", F.lit("source").alias("kind"))
    old = p.where("path % 7 <> 0").withColumn("content_hash", F.col("p_size"))
    new = p.where("path % 11 <> 0").withColumn("content_hash", F.when(F.col("path") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.change_counts(old, new)


@query("SELECT 'src/m' || o.p_partkey || '.py' AS seed, 'tests/test_m' || n.s_suppkey || '.py' AS path FROM part o JOIN supplier n ON o.p_partkey = n.s_suppkey")
def filename_heuristic(spark, sf_dir):
    """GR-9: tests by the names of their files."""
    s = table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    t = table(spark, sf_dir, "supplier").select(F.concat(F.lit("tests/test_m"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit("test").alias("kind"))
    return R.same_stem(s, t)


@query("SELECT sha256(string_agg(item_id || ' ' || sha256(text), chr(10) ORDER BY item_id::VARCHAR)) AS digest FROM benchmark")
def folder_digest(spark, sf_dir):
    """VC-7"""
    b = table(spark, sf_dir, "benchmark")
    return R.folder_digest(b.select(F.col("item_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))
