"""Registered queries of extraction, resolution, snapshots, reports and streaming, each with DuckDB's SQL.

The test tables hold no source code, so sources are spelled out from their rows and parsed like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import facts, logs, modules
from graphloom.operators import resolve as R
from graphloom.operators.settle import shared_dir
from graphloom.operators.snapshot import Store, save_artifacts
from graphloom.plans import star
from graphloom.plans.catalogue import _EDGES, query
from graphloom.plans.star import table
from graphloom.streaming import fold


def _python(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("import mod"), s, F.lit("\nfrom .pkg import helper as h\nclass C"), k, F.lit("(Base"), s, F.lit("):\n    def run(self, cb):\n        self.go()\n        mod"), s, F.lit(".call(cb)\n    def go(self):\n        return h("), k, F.lit(")\n"))
    return p.select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), F.sha2(text.cast("binary"), 256).alias("content_hash"), text.alias("text"))


_PY = "SELECT 'src/m' || p_partkey || '.py' AS path, p_partkey AS k, p_size AS s FROM part"


@query(f"WITH p AS ({_PY}) SELECT path, x.kind, CASE x.kind WHEN 'Class' THEN 'C' || k ELSE 'C' || k || '.' || x.n END AS qualname, x.a AS first, x.z AS last FROM p, (VALUES ('Class', '', 3, 8), ('Method', 'run', 4, 6), ('Method', 'go', 7, 8)) x(kind, n, a, z)")
def extract_python_symbols(spark, sf_dir):
    """EXT-2"""
    return facts.rows_of(facts.extracted(_python(spark, sf_dir)), "symbols").select("path", "kind", "qualname", "first", "last")


@query(f"WITH p AS ({_PY}) SELECT path, 'go' AS name, 'self' AS receiver, 5 AS line FROM p UNION ALL SELECT path, 'call', 'mod' || s, 6 FROM p UNION ALL SELECT path, 'h', NULL, 8 FROM p")
def extract_python_calls(spark, sf_dir):
    """EXT-4"""
    return facts.rows_of(facts.extracted(_python(spark, sf_dir)), "calls").select("path", "name", "receiver", "line")


@query(f"WITH p AS ({_PY}) SELECT path, 'mod' || s AS spec, 0 AS level, 'mod' || s AS local, NULL::VARCHAR AS member FROM p UNION ALL SELECT path, 'pkg', 1, 'h', 'helper' FROM p")
def extract_python_imports(spark, sf_dir):
    """EXT-3"""
    return facts.rows_of(facts.extracted(_python(spark, sf_dir)), "imports").select("path", "spec", "level", "local", "member")


@query(f"WITH p AS ({_PY}) SELECT path, 'cb' AS name, NULL::VARCHAR AS receiver, 6 AS line FROM p")
def extract_python_values(spark, sf_dir):
    """EXT-8: names that are used and not called."""
    return facts.rows_of(facts.extracted(_python(spark, sf_dir)), "values").select("path", "name", "receiver", "line")


def _javascript(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('import { load as get } from "./api";\nexport class S'), k, F.lit(" extends Base {\n  run(x) { return get(x); }\n}\nexport const make = () => new S"), k, F.lit("();\n"))
    return s.select(F.concat(F.lit("web/s"), k, F.lit(".ts")).alias("path"), F.sha2(text.cast("binary"), 256).alias("content_hash"), text.alias("text"))


@query("SELECT 'web/s' || s_suppkey || '.ts' AS path, x.kind, CASE x.n WHEN '' THEN 'S' || s_suppkey WHEN 'run' THEN 'S' || s_suppkey || '.run' ELSE x.n END AS qualname, x.a AS first, x.z AS last FROM supplier, (VALUES ('Class', '', 2, 4), ('Method', 'run', 3, 3), ('Function', 'make', 5, 5)) x(kind, n, a, z)")
def extract_javascript_symbols(spark, sf_dir):
    """EXT-9"""
    return facts.rows_of(facts.extracted(_javascript(spark, sf_dir)), "symbols").select("path", "kind", "qualname", "first", "last")


@query("SELECT 'web/s' || s_suppkey || '.ts' AS path, 'get' AS name, 3 AS line FROM supplier UNION ALL SELECT 'web/s' || s_suppkey || '.ts', 'S' || s_suppkey, 5 FROM supplier")
def extract_javascript_calls(spark, sf_dir):
    """EXT-12: calls and new."""
    return facts.rows_of(facts.extracted(_javascript(spark, sf_dir)), "calls").select("path", "name", "line")


# -- resolution ---------------------------------------------------------------


def _mod(c, n: int = 50):
    return F.concat(F.lit("m"), (c % n).cast("string"), F.lit(".py"))


def _name(c, n: int):
    return F.concat(F.lit("f"), (c % n).cast("string"))


@query("""WITH sym AS (SELECT DISTINCT 'm' || p_partkey % 50 || '.py' AS path, 'f' || p_partkey % 400 AS name FROM part),
bind AS (SELECT 'm' || c_custkey % 50 || '.py' AS path, 'f' || c_custkey % 500 AS name, min('m' || (c_custkey * 7) % 50 || '.py') AS file, bool_and(c_custkey % 11 = 0) AS ext FROM customer GROUP BY 1, 2),
loc AS (SELECT DISTINCT 'm' || s_suppkey % 50 || '.py' AS path, 'f' || s_suppkey % 500 AS name FROM supplier),
ref AS (SELECT o_orderkey AS ref, 'm' || o_custkey % 50 || '.py' AS path, 'f' || o_orderkey % 500 AS name, o_orderkey % 100 AS line FROM orders),
uni AS (SELECT name, min(path) AS path FROM sym GROUP BY name HAVING count(*) = 1),
j AS (SELECT ref.*, loc.name IS NOT NULL AND ref.line BETWEEN 10 AND 60 AS shadow, bind.name IS NOT NULL AS bound, bind.ext, bind.file, x.path AS via, y.path AS own, uni.path AS one
  FROM ref LEFT JOIN loc USING (path, name) LEFT JOIN bind USING (path, name) LEFT JOIN sym x ON x.path = bind.file AND x.name = ref.name LEFT JOIN sym y ON y.path = ref.path AND y.name = ref.name LEFT JOIN uni ON uni.name = ref.name)
SELECT ref, CASE WHEN bound AND via IS NOT NULL THEN via WHEN own IS NOT NULL THEN own ELSE one END || '::' || name AS target, CASE WHEN bound AND via IS NOT NULL THEN 0.95 WHEN own IS NOT NULL THEN 0.90 ELSE 0.75 END::DOUBLE AS confidence
FROM j WHERE NOT shadow AND NOT coalesce(bound AND ext, false) AND (coalesce(bound AND via IS NOT NULL, false) OR own IS NOT NULL OR one IS NOT NULL)""")
def resolve_cascade(spark, sf_dir):
    """RES-12/13, JN-3: local names, imports, the same module, unique names; rules that end the search come first."""
    part = table(spark, sf_dir, "part").select(_mod(F.col("p_partkey")).alias("path"), _name(F.col("p_partkey"), 400).alias("name")).distinct()
    symbols = part.select("path", "name", F.col("name").alias("qualname"), F.lit("Function").alias("kind"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.concat_ws("::", "path", "name").alias("node_key"), F.lit("m").alias("container"), F.lit(None).cast("string").alias("shape"))
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    binds = c.groupBy(_mod(key).alias("path"), _name(key, 500).alias("local")).agg(F.min(_mod(key * 7)).alias("file"), F.bool_and(key % 11 == 0).alias("external"))
    binds = binds.select("path", "local", F.lit(1).alias("line"), "file", F.col("local").alias("member"), "external", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    s = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(_mod(s).alias("path"), _name(s, 500).alias("name"), F.lit(10).alias("first"), F.lit(60).alias("last")).distinct()
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), _mod(F.col("o_custkey")).alias("path"), _name(F.col("o_orderkey"), 500).alias("name"), F.lit(None).cast("string").alias("receiver"), (F.col("o_orderkey") % 100).cast("int").alias("line"), F.lit(None).cast("string").alias("owner"))
    exports = symbols.select(F.col("path").alias("file"), "name", "node_key", "kind")
    return R.resolve(refs, symbols, binds, names, exports, None, ("Function", "Class"))


@query("""WITH f AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'pkg/sub/' ELSE CASE WHEN p_size % 3 = 1 THEN 'src/' ELSE '' END END || 'x' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path, p_partkey AS k FROM part),
i AS (SELECT 'pkg/sub/use.py' AS path, 'x' || o_orderkey AS spec, 0 AS level, o_orderkey AS k FROM orders), c AS (SELECT i.*, d.p AS k1, e.p AS k2, d.root || i.spec || e.tail AS file FROM i, (VALUES (0, ''), (1, 'pkg/'), (2, 'pkg/sub/'), (3, 'src/'), (4, 'lib/')) d(p, root), (VALUES (0, '.py'), (1, '/__init__.py')) e(p, tail))
SELECT c.path, spec, level, arg_min(file, k1 * 2 + k2) AS file, CASE WHEN min(k1 * 2 + k2) < 2 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM c JOIN (SELECT path FROM f) f ON f.path = c.file GROUP BY c.path, spec, level""")
def resolve_python_modules(spark, sf_dir):
    """RES-2, JN-4: the first of ordered candidates that is a file."""
    p = table(spark, sf_dir, "part")
    root = F.when(F.col("p_size") % 3 == 0, "pkg/sub/").when(F.col("p_size") % 3 == 1, "src/").otherwise("")
    files = p.select(F.concat(root, F.lit("x"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise("/__init__.py")).alias("path")).distinct()
    imports = table(spark, sf_dir, "orders").select(F.lit("pkg/sub/use.py").alias("path"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("spec"), F.lit(0).alias("level"))
    return modules.resolve_python(imports, files)


@query(r"""WITH RECURSIVE u AS (SELECT DISTINCT rtrim(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '/') AS path FROM pages), a AS (SELECT path, path AS p FROM u UNION SELECT path, regexp_replace(p, '/?[^/]*$', '') FROM a WHERE p <> '')
SELECT DISTINCT regexp_replace(p, '/?[^/]*$', '') AS source_key, p AS target_key, 'CONTAINS' AS relation FROM a WHERE regexp_replace(p, '/?[^/]*$', '') <> ''""")
def path_containers(spark, sf_dir):
    """RES-22: folders that hold folders and files."""
    u = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), "/+$", "").alias("path")).distinct()
    return modules.containers(u).distinct()


def _class_bases(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    one = n.select(key("N", F.col("n_nationkey")).alias("class_key"), F.lit(0).alias("place"), key("R", F.col("n_regionkey")).alias("base_key"))
    two = n.where("n_nationkey % 4 = 0").select(key("N", F.col("n_nationkey")).alias("class_key"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("base_key"))
    three = table(spark, sf_dir, "region").select(key("R", F.col("r_regionkey")).alias("class_key"), F.lit(0).alias("place"), F.lit("Root").alias("base_key"))
    return one.union(two).union(three)


@query("""SELECT 'N' || n_nationkey AS class_key, x.p AS place, CASE x.p WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN 'R' || n_regionkey ELSE 'Root' END AS base_key, false AS opaque FROM nation, (VALUES (0), (1), (2)) x(p)
UNION ALL SELECT 'R' || r_regionkey, x.p, CASE x.p WHEN 0 THEN 'R' || r_regionkey ELSE 'Root' END, false FROM region, (VALUES (0), (1)) x(p)""")
def class_linearisation(spark, sf_dir):
    """RES-10, GR-14: C3 orders; an opaque base that is declared last stands behind all others."""
    return R.hierarchy(_class_bases(spark, sf_dir))


# -- snapshots and sinks ------------------------------------------------------


@query(f"WITH {_EDGES} SELECT s AS source_key, t AS target_key, r AS relation, c AS confidence FROM e")
def snapshot_published(spark, sf_dir):
    """SNK-2: what is read behind the pointer is what was published."""
    return star.published(spark, sf_dir).select("source_key", "target_key", "relation", "confidence")


@query("SELECT DISTINCT sha256(text) AS key FROM benchmark WHERE text IS NOT NULL")
def artifact_keys(spark, sf_dir):
    """SNK-7: texts by their digest, once each."""
    return save_artifacts(table(spark, sf_dir, "benchmark").select("text"), f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}")


@query("SELECT 2::BIGINT AS generations, true AS swapped, (SELECT count(*) FROM nation) AS rows_read")
def snapshot_generations(spark, sf_dir):
    """SNK-1/2, GR-10: a second generation takes the first one's place."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    one = store.publish({"t": table(spark, sf_dir, "region")})
    two = store.publish({"t": table(spark, sf_dir, "nation")})
    n = store.table("t").count()
    return spark.createDataFrame([(len({one, two}), store.generation() == two and store.metadata()["previous"] == one, n)], "generations long, swapped boolean, rows_read long")


# -- session reports and streams ------------------------------------------------


def _typed(events):
    kind = F.when(F.col("event_type") == "purchase", "usage").when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "result").otherwise("other")
    k = F.get_json_object("props", "$.k").cast("long")
    null = F.lit(None).cast("long")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("client"), F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("ts"), kind.alias("kind"),
        (F.col("event_id") % 7).cast("string").alias("message_id"), F.when(kind.isin("call", "result"), (F.col("event_id") % 40).cast("string")).alias("call_id"), F.when(kind == "call", F.col("event_type")).alias("name"),
        F.when(kind == "call", F.when(k % 2 == 0, "edit").otherwise("check")).alias("command"), F.when(kind == "result", F.col("value") > 10).alias("ok"), F.lit(False).alias("sidechain"), F.lit("m").alias("model"),
        *[F.when(kind == "usage", k).otherwise(null).alias(c) for c in logs.COUNTERS],
    )


_TYPED = """t AS (SELECT 'u' || user_id AS session, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS client, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'usage' WHEN 'click' THEN 'call' WHEN 'view' THEN 'result' ELSE 'other' END AS kind,
event_id % 7 AS m, event_id % 40 AS c, (props ->> '$.k')::BIGINT AS k, value > 10 AS ok FROM events)"""


@query(f"""WITH {_TYPED}, a AS (SELECT session, arg_max(k, seq) AS total FROM t WHERE kind = 'usage' AND client = 'a' GROUP BY 1), b AS (SELECT session, sum(k)::BIGINT AS total FROM (SELECT session, m, max(k) AS k FROM t WHERE kind = 'usage' AND client = 'b' GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT session, count(*) AS n_calls, count(*) FILTER (ok) AS n_passed, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (ok IS NULL) AS n_unfinished FROM (SELECT DISTINCT session, c FROM t WHERE kind = 'call') LEFT JOIN (SELECT session, c, max(ok) AS ok FROM t WHERE kind = 'result' GROUP BY 1, 2) USING (session, c) GROUP BY 1)
SELECT s.session, s.client, coalesce(a.total, b.total) AS total_tokens, n_calls, n_passed, n_failed, n_unfinished FROM (SELECT session, min(client) AS client FROM t GROUP BY 1) s LEFT JOIN a USING (session) LEFT JOIN b USING (session) LEFT JOIN r USING (session)""")
def session_reports(spark, sf_dir):
    """LG-1, LG-3, LG-5: usage of two clients, calls and their results."""
    return logs.session_reports(_typed(table(spark, sf_dir, "events"))).select("session", "client", "total_tokens", "n_calls", "n_passed", "n_failed", "n_unfinished")


@query(f"WITH {_TYPED} SELECT session, count(*) AS n_calls, count(*) - count(DISTINCT c) AS redundant FROM t WHERE kind = 'call' GROUP BY 1")
def redundant_calls(spark, sf_dir):
    """EV-12"""
    return _typed(table(spark, sf_dir, "events")).where("kind = 'call'").groupBy("session").agg(F.count("*").alias("n_calls"), (F.count("*") - F.countDistinct("call_id")).alias("redundant"))


def _run_stream(query_, path: str) -> None:
    q = query_.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query(f"""WITH {_TYPED}, b AS (SELECT session, sum(k)::BIGINT AS total FROM (SELECT session, m, max(k) AS k FROM t WHERE kind = 'usage' AND client = 'b' GROUP BY 1, 2) GROUP BY 1), a AS (SELECT session, arg_max(k, seq) AS total FROM t WHERE kind = 'usage' AND client = 'a' GROUP BY 1)
SELECT session, count(*) AS n_events, count(*) FILTER (kind = 'call') AS n_calls, 0::BIGINT AS n_malformed, max(coalesce(a.total, b.total)) AS total_tokens, max(seq) AS last_seq FROM t LEFT JOIN a USING (session) LEFT JOIN b USING (session) GROUP BY session""")
def stream_session_fold(spark, sf_dir):
    """SM-1 to SM-5, SRC-12: sessions folded by a stream, published by batch."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = [0]

    def publish(df, batch):
        fold.publish(df, batch, f"{path}/reports")
        last[0] = batch

    _run_stream(fold.fold(_typed(_stream(spark, sf_dir))).writeStream.outputMode("update").foreachBatch(publish), path)
    return spark.read.parquet(f"{path}/reports/v={last[0]}").drop("batch", "n_children")


@query("SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    """An extension: event-time windows with a watermark, run to the end of the input."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def publish(df, batch):
        df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total")).write.mode("overwrite").parquet(f"{path}/windows")

    _run_stream(fold.windowed(_stream(spark, sf_dir), late="10000 hours").writeStream.outputMode("complete").foreachBatch(publish), path)
    return spark.read.parquet(f"{path}/windows")
