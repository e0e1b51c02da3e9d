"""Registered queries on the test tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import name_shape, normal_name, words
from graphloom.operators import edges as E
from graphloom.operators import graph as G
from graphloom.operators import lookup as L
from graphloom.operators import text as T
from graphloom.operators import vector as V
from graphloom.plans import star
from graphloom.plans.star import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def keys(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node_key string")


# -- the graph in SQL ---------------------------------------------------------

_EDGES = """
raw AS (
  SELECT 'region::' || n_regionkey AS s, 'nation::' || n_nationkey AS t, 'CONTAINS' AS r, 1.0::DOUBLE AS c FROM nation
  UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 'IMPORTS', 1.0 FROM customer
  UNION ALL SELECT 'customer::' || o_custkey, 'orders::' || o_orderkey, 'CALLS', CASE o_orderstatus WHEN 'F' THEN 0.95 WHEN 'O' THEN 0.90 ELSE 0.85 END FROM orders
  UNION ALL SELECT 'orders::' || l_orderkey, 'part::' || l_partkey, 'CALLS', CASE l_returnflag WHEN 'R' THEN 0.95 WHEN 'A' THEN 0.90 ELSE 0.75 END FROM lineitem
  UNION ALL SELECT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'REFERENCES', CASE l_linestatus WHEN 'F' THEN 0.90 ELSE 0.55 END FROM lineitem
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'INHERITS', 0.95 FROM supplier),
ded AS (SELECT s, t, r, max(c) AS c FROM raw GROUP BY s, t, r),
edge AS (SELECT *, CASE WHEN r IN ('IMPORTS', 'CONTAINS') THEN 'path' WHEN round(c, 2) = 0.95 THEN 'import_map' WHEN round(c, 2) = 0.90 THEN 'same_module' WHEN round(c, 2) = 0.85 THEN 'inherited'
  WHEN round(c, 2) = 0.75 THEN 'unique_name' WHEN round(c, 2) = 0.55 THEN 'suffix' ELSE 'unknown' END AS tier FROM ded),
e AS (SELECT *, CASE WHEN tier IN ('unique_name', 'suffix') THEN 'candidate' ELSE 'resolved' END AS status FROM edge)"""
_NODES = """
node AS (SELECT 'region::' || r_regionkey AS k, 'region' AS kind FROM region UNION ALL SELECT 'nation::' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer::' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'part::' || p_partkey, 'part' FROM part UNION ALL SELECT 'orders::' || o_orderkey, 'orders' FROM orders)"""


def _reach_sql(targets: list[str], depth: int, incoming: bool, relations: list[str] | None, candidates: bool) -> str:
    """All walks, not layers."""
    a, b = ("t", "s") if incoming else ("s", "t")
    where = " AND ".join(["TRUE"] + (["status = 'resolved'"] if not candidates else []) + ([f"r IN ({', '.join(repr(r) for r in relations)})"] if relations else []))
    seeds = ", ".join(f"('{t}')" for t in targets)
    return f"""
WITH RECURSIVE {_EDGES},
x AS (SELECT {a} AS a, {b} AS b, r, c, status = 'candidate' AS cand FROM e WHERE {where}),
w(tgt, node, d, c, cand, r) AS (SELECT v, v, 0, 1.0::DOUBLE, FALSE, NULL::VARCHAR FROM (VALUES {seeds}) s(v) UNION SELECT w.tgt, x.b, w.d + 1, w.c * x.c, w.cand OR x.cand, x.r FROM w JOIN x ON w.node = x.a WHERE w.d < {depth}),
m AS (SELECT tgt, node, min(d) AS d FROM w GROUP BY tgt, node HAVING min(d) > 0),
k AS (SELECT w.* FROM w JOIN m USING (tgt, node, d))
SELECT tgt AS "of", node AS node_key, d::INT AS distance, round(max(c), 4) AS confidence, array_to_string(list_sort(list(DISTINCT r)), ',') AS relations,
  CASE WHEN arg_max(cand, (c, NOT cand)) THEN 'candidate' ELSE 'resolved' END AS resolution_status FROM k GROUP BY tgt, node, d"""


def _shown(reached: DataFrame) -> DataFrame:
    return reached.withColumn("confidence", F.round("confidence", 4)).withColumn("relations", F.array_join("relations", ","))


@query(f"WITH {_EDGES} SELECT s AS source_key, t AS target_key, r AS relation, c AS confidence, tier AS resolution_tier, status AS resolution_status FROM e")
def edges_projected(spark, sf_dir):
    """RES-17/18, AG-5: edges once each, with the best confidence and the tier it means."""
    return star.edges(spark, sf_dir)


@query(f"WITH {_EDGES}, n(relation) AS (VALUES ('IMPORTS'), ('CALLS'), ('INHERITS'), ('REFERENCES')) SELECT relation, count(r)::BIGINT AS n FROM n LEFT JOIN e ON r = relation GROUP BY relation")
def edge_counts(spark, sf_dir):
    """AG-1"""
    return E.counts(star.published(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT r AS relation, tier AS resolution_tier, status AS resolution_status, count(*)::BIGINT AS n, round(avg(c), 4) AS mean_confidence FROM e GROUP BY ALL")
def edge_tiers(spark, sf_dir):
    """AG-14: edges by relation, tier and status."""
    return star.published(spark, sf_dir).groupBy("relation", "resolution_tier", "resolution_status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query(_reach_sql(["part::7"], 3, True, None, False))
def callers_d3(spark, sf_dir):
    """GR-1, JN-2, AG-4: what reaches a part within three hops."""
    return _shown(G.reach(star.published(spark, sf_dir, "target_key"), keys(spark, "part::7"), 3, incoming=True))


@query(_reach_sql(["customer::7"], 3, False, None, False))
def dependents_d3(spark, sf_dir):
    """GR-1 along the edges."""
    return _shown(G.reach(star.published(spark, sf_dir), keys(spark, "customer::7"), 3, incoming=False))


@query(_reach_sql(["customer::7"], 3, False, None, True))
def dependents_candidates(spark, sf_dir):
    """FLT-8: candidate edges too."""
    return _shown(G.reach(star.published(spark, sf_dir), keys(spark, "customer::7"), 3, incoming=False, candidates=True))


@query(_reach_sql(["customer::7", "supplier::3", "orders::11"], 2, False, ["CALLS", "REFERENCES", "INHERITS"], True))
def reach_multi_target(spark, sf_dir):
    """GR-2, FLT-9: several targets, chosen relations."""
    return _shown(G.reach(star.published(spark, sf_dir), keys(spark, "customer::7", "supplier::3", "orders::11"), 2, incoming=False, relations=("CALLS", "REFERENCES", "INHERITS"), candidates=True))


@query(f"WITH {_EDGES} SELECT s AS source_key, t AS target_key, round(1 / greatest(max(c), 0.01), 6) AS weight, array_to_string(list_sort(list(DISTINCT r)), ',') AS relations FROM e WHERE status = 'resolved' GROUP BY s, t")
def parallel_edges(spark, sf_dir):
    """GR-4"""
    return G.parallel(star.published(spark, sf_dir)).select("source_key", "target_key", F.round("weight", 6).alias("weight"), F.array_join("relations", ",").alias("relations"))


_PATHS = f"""WITH RECURSIVE {_EDGES}, x AS (SELECT s, t, 1 / greatest(max(c), 0.01) AS w FROM e WHERE status = 'resolved' GROUP BY s, t),
p(node, cost, hops, path) AS (SELECT 'customer::7', 0.0::DOUBLE, 0, 'customer::7' UNION ALL SELECT x.t, p.cost + x.w, p.hops + 1, p.path || ' > ' || x.t FROM p JOIN x ON p.node = x.s WHERE p.hops < 3),
b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(cost, 9), path) AS k FROM p)"""


@query(f"{_PATHS} SELECT node AS node_key, round(cost, 4) AS cost, hops::INT AS hops, path FROM b WHERE k = 1")
def shortest_path_cost(spark, sf_dir):
    """GR-5: the cheapest paths of at most three hops from one source."""
    return G.shortest_paths(star.published(spark, sf_dir), keys(spark, "customer::7"), 3).select("node_key", F.round("cost", 4).alias("cost"), "hops", "path")


@query(f"{_PATHS} SELECT path, hops::INT AS hops, round(cost, 4) AS cost, NULL::VARCHAR AS reason FROM b WHERE k = 1 AND node LIKE 'supplier::%' ORDER BY round(cost, 9), node, path LIMIT 1")
def trace_path(spark, sf_dir):
    """GR-6: the cheapest path to any supplier."""
    e = star.published(spark, sf_dir)
    return G.trace(e, keys(spark, "customer::7"), star.nodes(spark, sf_dir).where("kind = 'supplier'"), 3)


@query("SELECT NULL::VARCHAR AS path, NULL::INT AS hops, NULL::DOUBLE AS cost, 'no path' AS reason")
def trace_no_path(spark, sf_dir):
    """GR-7: no path is an answer."""
    return G.trace(star.published(spark, sf_dir), keys(spark, "orders::11"), keys(spark, "nowhere::1"), 2)


@query(f"{_PATHS}, q AS (SELECT *, min(round(cost, 9)) OVER (PARTITION BY node) AS best FROM p WHERE node = 'supplier::3') SELECT path FROM q WHERE round(cost, 9) = best")
def all_cheapest_paths(spark, sf_dir):
    """GR-12"""
    return G.all_cheapest(star.published(spark, sf_dir), "customer::7", "supplier::3", 3)


@query(f"""WITH RECURSIVE {_EDGES}, {_NODES}, x AS (SELECT t AS a, s AS b, r FROM e WHERE status = 'resolved'),
w(seed, node, d, ev, rel) AS (SELECT v, v, 0, v, '' FROM (VALUES ('supplier::3'), ('part::7')) s(v) UNION ALL SELECT w.seed, x.b, w.d + 1, w.ev || ' > ' || x.b, CASE WHEN w.rel = '' THEN x.r ELSE w.rel || ',' || x.r END FROM w JOIN x ON w.node = x.a WHERE w.d < 3),
m AS (SELECT *, min(d) OVER (PARTITION BY seed, node) AS best FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY ev, rel) AS n FROM m WHERE d = best)
SELECT seed, node AS node_key, kind, d::INT AS distance, ev AS evidence, rel AS hop_relations FROM k JOIN node ON k = node WHERE FALSE""".replace(" JOIN node ON k = node WHERE FALSE", " LEFT JOIN node ON node.k = k.node WHERE n = 1 AND d > 0 AND kind IN ('orders', 'customer')"))
def impact_incoming(spark, sf_dir):
    """GR-8: what a change reaches, with evidence, in two kinds of nodes."""
    return G.impact(star.published(spark, sf_dir, "target_key"), keys(spark, "supplier::3", "part::7"), star.nodes(spark, sf_dir), 3, scopes=("orders", "customer"))


def _snapshot(spark, sf_dir, before: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(before)))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
p AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT o_custkey, CASE WHEN o.n IS NULL THEN 'added' WHEN p.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN p USING (o_custkey) WHERE o.n IS DISTINCT FROM p.n OR o.total IS DISTINCT FROM p.total""")
def snapshot_diff(spark, sf_dir):
    """GR-10, ST-3, JN-10, JN-11: null-safe difference of two snapshots."""
    return E.difference(_snapshot(spark, sf_dir, "1995-01-01 00:00:00"), _snapshot(spark, sf_dir, "1996-01-01 00:00:00"), ["o_custkey"], ["n", "total"])


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
p AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT * FROM p UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM p)""")
def snapshot_upsert(spark, sf_dir):
    """SNK-3: new rows win over old ones by key."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))
    new = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return E.upserted(_snapshot(spark, sf_dir, "1995-01-01 00:00:00"), new, ["o_custkey"])


@query(f"""WITH {_EDGES}, z AS (SELECT v AS seed FROM (VALUES ('part::7'), ('supplier::3')) s(v)),
n AS (SELECT seed, 'outgoing' AS direction, t AS node_key, r, c FROM z JOIN e ON seed = s UNION ALL SELECT seed, 'incoming', s, r, c FROM z JOIN e ON seed = t),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY direction, c DESC, node_key, r) AS place, count(*) OVER (PARTITION BY seed) > 6 AS truncated FROM n)
SELECT seed, direction, node_key, r AS relation, c AS confidence, place::INT AS place, truncated FROM k WHERE place <= 6""")
def neighbourhood_top6(spark, sf_dir):
    """GR-11, TK-6, JN-1, JN-8"""
    return G.neighbourhood(star.published(spark, sf_dir), keys(spark, "part::7", "supplier::3"))


@query(f"""WITH {_EDGES}, y AS (SELECT DISTINCT s AS a, t AS b FROM e WHERE status = 'resolved' AND r IN ('IMPORTS', 'INHERITS', 'CONTAINS', 'REFERENCES') AND s <> t),
two AS (SELECT x.a, x.b AS m, z.b FROM y x JOIN y z ON x.b = z.a WHERE x.a <> z.b),
three AS (SELECT two.a, two.m, two.b AS n, y.b FROM two JOIN y ON two.b = y.a WHERE two.a <> y.b AND two.m <> y.b),
o AS (SELECT a, b, count(*) AS k, min(a || ' > ' || m || ' > ' || n || ' > ' || b) AS path FROM three GROUP BY a, b HAVING count(*) = 1)
SELECT a AS source_key, b AS target_key, path FROM o WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.a = o.a AND y.b = o.b) AND NOT EXISTS (SELECT 1 FROM two WHERE two.a = o.a AND two.b = o.b)""")
def chains_three_hops(spark, sf_dir):
    """GR-13: unique three-hop chains. They take every edge of their relations once, so no snapshot in the order of ends is published for them."""
    return G.chains(star.edges(spark, sf_dir), ("IMPORTS", "INHERITS", "CONTAINS", "REFERENCES"))


@query(f"WITH {_EDGES} SELECT s AS source_key, t AS target_key, r AS relation FROM e WHERE t NOT IN (SELECT 'part::' || p_partkey FROM part WHERE p_size > 25) AND t LIKE 'part::%'")
def dangling_edges(spark, sf_dir):
    """JN-17, FLT-13: edges to parts that a smaller node table does not have."""
    n = star.nodes(spark, sf_dir)
    big = n.where("kind <> 'part'").select("node_key").union(table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string"))))
    return E.dangling(star.published(spark, sf_dir).where("target_key LIKE 'part::%'"), big)


@query(f"WITH {_EDGES} SELECT s AS source_key, count(*)::BIGINT AS fan_out, count(DISTINCT t)::BIGINT AS n_targets FROM e WHERE r = 'CALLS' GROUP BY s HAVING count(DISTINCT t) BETWEEN 3 AND 15")
def fan_out_candidates(spark, sf_dir):
    """AG-26"""
    c = star.published(spark, sf_dir).where("relation = 'CALLS'").groupBy("source_key").agg(F.count("*").alias("fan_out"), F.countDistinct("target_key").alias("n_targets"))
    return c.where("n_targets BETWEEN 3 AND 15")


@query(f"WITH {_EDGES}, {_NODES} SELECT kind, count(*)::BIGINT AS n FROM node WHERE k NOT IN (SELECT t FROM e) GROUP BY kind")
def no_static_use(spark, sf_dir):
    """AG-24: nodes that no edge leads to."""
    used = star.published(spark, sf_dir).select(F.col("target_key").alias("node_key"))
    return star.nodes(spark, sf_dir).join(used, "node_key", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, count(*)::BIGINT AS n FROM part GROUP BY p_name HAVING count(*) >= 2")
def ambiguous_names(spark, sf_dir):
    """AG-25, RES-13"""
    return star.symbols(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).where("n >= 2")


# -- lookup -------------------------------------------------------------------

_SYM = "sym AS (SELECT 'part::' || p_partkey AS node_key, p_name AS name, p_brand || '::' || p_name AS qualified_name, 'src/' || p_brand AS file_path, p_size AS start_line FROM part)"
_FILES = r"files AS (SELECT regexp_extract(url, '^[^:]*://(.*)$', 1) AS path, CASE WHEN page_id % 3 = 0 THEN 'test' ELSE 'source' END AS kind, sha256(html) AS content_hash FROM pages)"


@query(f"WITH {_FILES} SELECT path, kind FROM files WHERE kind = 'source' AND contains(path, 'example.net')")
def find_files_literal(spark, sf_dir):
    """FLT-2"""
    return L.find_files(star.files(spark, sf_dir), "source", "example.net").select("path", "kind")


@query(f"WITH {_FILES} SELECT path, kind FROM files WHERE lower(path) LIKE '%example_org%en/%'")
def find_files_like(spark, sf_dir):
    """FLT-1: wildcards, ASCII case aside."""
    return L.find_files(star.files(spark, sf_dir), None, "EXAMPLE_org%en/", wildcards=True).select("path", "kind")


@query(f"WITH {_SYM}, t AS (SELECT min(name) AS q FROM sym), h AS (SELECT *, name = q AS ex FROM sym, t WHERE name = q OR contains(lower(name), lower(q))) SELECT node_key, name FROM h WHERE ex = (SELECT max(ex) FROM h)")
def find_symbol_exact(spark, sf_dir):
    """FLT-3: an exact name hides names that only contain it."""
    s = star.symbols(spark, sf_dir)
    return L.find_symbol(s, s.agg(F.min("name")).first()[0]).select("node_key", "name")


@query(f"WITH {_SYM} SELECT node_key, name FROM sym WHERE contains(lower(name), 'ea') AND NOT EXISTS (SELECT 1 FROM sym WHERE name = 'ea')")
def find_symbol_substring(spark, sf_dir):
    """FLT-3: without an exact name, names that contain it."""
    return L.find_symbol(star.symbols(spark, sf_dir), "EA").select("node_key", "name")


@query(f"WITH {_SYM} SELECT node_key, qualified_name FROM sym WHERE qualified_name = (SELECT max(qualified_name) FROM sym)")
def find_symbol_qualified(spark, sf_dir):
    """FLT-3: a qualified name is never widened."""
    s = star.symbols(spark, sf_dir)
    return L.find_symbol(s, s.agg(F.max("qualified_name")).first()[0]).select("node_key", "qualified_name")


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS position FROM customer QUALIFY position BETWEEN 21 AND 40")
def page_2(spark, sf_dir):
    """TK-2"""
    return L.page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 20)


@query(f"WITH {_SYM}, {_FILES} SELECT name, qualified_name AS symbol_id, file_path AS file, start_line AS line FROM sym WHERE file_path = 'src/Brand#11' ORDER BY line, node_key")
def list_symbols_file(spark, sf_dir):
    """FLT-6, FLT-10"""
    return L.brief(L.list_symbols(star.symbols(spark, sf_dir), "src/Brand#11")).select("name", "symbol_id", "file", "line")


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path FROM pages), m(folder, rule) AS (SELECT DISTINCT regexp_extract(path, '^[^/]*'), 'host' FROM u WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*'), 'lang' FROM u WHERE page_id % 3 = 0),
a AS (SELECT page_id, path, folder, rule, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(folder, '/')) DESC) AS k FROM u JOIN m ON starts_with(path, folder || '/'))
SELECT page_id, folder, rule FROM a WHERE k = 1""")
def module_ancestor_join(spark, sf_dir):
    """JN-7: the deepest ancestor folder that has a mark."""
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path"))
    m = u.where("page_id % 2 = 0").select(F.regexp_extract("path", "^[^/]*", 0).alias("folder"), F.lit("host").alias("rule"))
    m = m.union(u.where("page_id % 3 = 0").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0), F.lit("lang"))).distinct()
    return L.nearest_ancestor(u, "path", m).select("page_id", "folder", "rule")


@query("SELECT p_partkey, regexp_replace(lower(p_name), '_', '', 'g') AS normal FROM part")
def normal_names(spark, sf_dir):
    """RES-15"""
    return table(spark, sf_dir, "part").select("p_partkey", normal_name("p_name").alias("normal"))


@query("""SELECT c_custkey, CASE WHEN len(t) >= 2 THEN array_to_string(t, ' ') || '|0|0' END AS shape FROM (SELECT c_custkey, list_transform(regexp_extract_all(c_name, '[A-Z][a-z]+|[a-z]+|[0-9]+|[A-Z]+'), lambda x: lower(x)) AS t FROM customer)""")
def name_shapes(spark, sf_dir):
    """RES-15: word tokens of multi-word names."""
    return table(spark, sf_dir, "customer").select("c_custkey", name_shape("c_name").alias("shape"))


# -- text and vectors ---------------------------------------------------------

_CAMEL = r"regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
_WORDS = r"regexp_extract_all(lower(" + _CAMEL + r"), '[\p{{L}}\p{{N}}]+')"


@query(f"SELECT doc_id, len({_WORDS.format('text')})::INT AS n_words, array_to_string(({_WORDS.format('text')})[1:5], ' ') AS head FROM documents")
def document_words(spark, sf_dir):
    """TX-1"""
    return table(spark, sf_dir, "documents").withColumn("w", words("text")).select("doc_id", F.size("w").alias("n_words"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query(r"""WITH RECURSIVE d AS (SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'en' THEN 'doc' ELSE 'source' END AS scope, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM documents),
l AS (SELECT path, scope, i, lines[i] AS line, strlen(lines[i]) AS size, scope = 'doc' AND starts_with(lines[i], '#') AS head FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
r(path, i, start, n, bytes) AS (SELECT path, i, 1::BIGINT, 1::BIGINT, size::BIGINT FROM l WHERE i = 1
  UNION ALL SELECT l.path, l.i, CASE WHEN r.n >= 32 OR r.bytes + l.size > 4096 OR l.head THEN l.i ELSE r.start END, CASE WHEN r.n >= 32 OR r.bytes + l.size > 4096 OR l.head THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 32 OR r.bytes + l.size > 4096 OR l.head THEN l.size ELSE r.bytes + l.size END
  FROM r JOIN l ON l.path = r.path AND l.i = r.i + 1)
SELECT path, start::INT AS start_line, max(i)::INT AS end_line FROM r GROUP BY path, start""")
def chunk_documents(spark, sf_dir):
    """TX-2"""
    return T.chunks(star.texts(spark, sf_dir)).select("path", "start_line", "end_line")


_BM25 = rf"""WITH u AS (SELECT doc_id, lang, {_WORDS.format("text")} AS ws FROM documents),
q AS (SELECT DISTINCT unnest(list_distinct_ordered) AS term FROM (SELECT (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT {_WORDS.format("text")} AS x FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))) GROUP BY w ORDER BY i LIMIT 32)) AS list_distinct_ordered)),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM u),
t AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(ws) AS dl, unnest(ws) AS term FROM u) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
z AS (SELECT doc_id, lang, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS p FROM t JOIN f USING (term), s)"""


@query(f"{_BM25} SELECT doc_id, round(sum(p), 4) AS score FROM z GROUP BY doc_id ORDER BY sum(p) DESC, doc_id LIMIT 200")
def bm25_top200(spark, sf_dir):
    """TX-4, TK-5: a benchmark item as the query."""
    b = table(spark, sf_dir, "benchmark")
    q = T.query_terms(b.orderBy("item_id").limit(1))
    return T.search(*star.words_of_documents(spark, sf_dir), q, ["doc_id"]).withColumn("score", F.round("score", 4))


@query(f"{_BM25} SELECT doc_id, round(sum(p), 4) AS score FROM z WHERE lang = 'en' GROUP BY doc_id ORDER BY sum(p) DESC, doc_id LIMIT 50")
def bm25_scoped(spark, sf_dir):
    """TX-4 with a scope: statistics stay those of all documents."""
    q = T.query_terms(table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1))
    return T.search(*star.words_of_documents(spark, sf_dir), q, ["doc_id"], F.col("lang") == "en", 50).withColumn("score", F.round("score", 4))


@query(f"""{_BM25}, b AS (SELECT doc_id, sum(p) AS score FROM z GROUP BY doc_id ORDER BY sum(p) DESC, doc_id LIMIT 200), r AS (SELECT doc_id, source, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS k FROM b JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS pass, min(k) OVER (PARTITION BY source) AS f FROM r) SELECT doc_id, source, row_number() OVER (ORDER BY pass, f)::INT AS position FROM p""")
def round_robin_files(spark, sf_dir):
    """WN-2: the 200 best documents of a query, sources taking turns."""
    q = T.query_terms(table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1))
    best = T.search(*star.words_of_documents(spark, sf_dir), q, ["doc_id"]).withColumn("score", F.round("score", 9))
    d = F.broadcast(best).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return T.round_robin(d, "source", [F.col("score").desc(), F.col("doc_id")]).select("doc_id", "source", "position")


@query(r"""WITH l AS (SELECT doc_id, i, x[i] AS line, len(x) AS n FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))
SELECT doc_id, count(*)::BIGINT AS kept, sum(i)::BIGINT AS lines FROM (SELECT *, max(regexp_matches(line, '[0-9]')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM l) WHERE near OR i <= 20 OR i > n - 10 GROUP BY doc_id""")
def log_condense_frame(spark, sf_dir):
    """EXT-18, WN-6: lines around those with a digit, and the first and last ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    return T.condensed(d, "doc_id", "i", "line", "[0-9]").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("i").cast("long").alias("lines"))


_UNIT = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), q AS (SELECT e AS w FROM n WHERE vec_id = (SELECT min(vec_id) FROM n)), s AS (SELECT vec_id, list_dot_product(e, w) AS score FROM n, q)"


@query(f"WITH {_UNIT} SELECT vec_id, round(score, 4) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 200")
def cosine_top(spark, sf_dir):
    """VC-1/4, TK-4"""
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_top(e, "vec_id", "embedding", e.orderBy("vec_id").limit(1), 64).withColumn("score", F.round("score", 4))


@query(f"""{_BM25}, a AS (WITH {_UNIT} SELECT vec_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS k FROM s QUALIFY k <= 100),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS k FROM (SELECT doc_id, sum(p) AS score FROM z GROUP BY doc_id ORDER BY sum(p) DESC, doc_id LIMIT 100)), x AS (SELECT id, 'semantic' AS src, k FROM a UNION ALL SELECT id, 'lexical', k FROM b)
SELECT id, round(sum(1.0 / (60 + k)), 6) AS score, array_to_string(list_sort(list(src)), '+') AS reason FROM x GROUP BY id ORDER BY round(sum(1.0 / (60 + k)), 12) DESC, id LIMIT 150""")
def rrf_fused(spark, sf_dir):
    """VC-5, WN-1: nearest vectors and best documents of a query's words, fused by rank."""
    e = table(spark, sf_dir, "embeddings")
    a = V.cosine_top(e, "vec_id", "embedding", e.orderBy("vec_id").limit(1), 64, top=100).withColumnRenamed("vec_id", "id").withColumn("score", F.round("score", 9))
    q = T.query_terms(table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1))
    b = T.search(*star.words_of_documents(spark, sf_dir), q, ["doc_id"], top=100).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    return V.fused({"semantic": a, "lexical": b}, "id", top=150).withColumn("score", F.round("score", 6))
