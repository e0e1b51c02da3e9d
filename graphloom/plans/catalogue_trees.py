"""Registered queries of source trees, projects, sinks, evidence, vectors and ledgers, each with DuckDB's SQL."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid

from pyspark.sql import functions as F

from graphloom import timing
from graphloom.functions.scalar import base_name, folder, stem, suffix
from graphloom.operators import edges as E
from graphloom.operators import evaluate, facts, graph, logs, lookup, modules, observe, pack, reports, resolve, snapshot, text, vector
from graphloom.operators.settle import forget_at_exit, shared_dir
from graphloom.plans import star
from graphloom.plans.cases import literal
from graphloom.plans.catalogue import _EDGES, _SYM, keys, query
from graphloom.plans.star import table
from graphloom.sources import repo, small, transcripts
from graphloom.sources.classify import secret_path
from graphloom.streaming import fold


def _place(spark, name: str) -> str:
    """A new folder in the shared one, gone at the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    return path


def _mounted(spark, name: str) -> str:
    """A folder that every process of this machine opens, for sources that are mounted folders."""
    path = _place(spark, name).removeprefix("file://").removeprefix("file:")
    return path if path.startswith("/") else tempfile.mkdtemp(prefix=f"graphloom-{name}-")


# -- trees and projects -----------------------------------------------------------


def _write(root: str, files: dict[str, str]) -> None:
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(content)


def _tree(spark, sf_dir) -> str:
    root = _mounted(spark, "tree")
    files = {".gitignore": "r3/\n*.tmp\n", "r2/.gitignore": "!n*.tmp\n", "node_modules/x.js": "x", ".git/config": "g"}
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
        k, g = r["n_nationkey"], r["n_regionkey"]
        files |= {f"r{g}/n{k}.py": f"x = {k}\n", f"r{g}/n{k}.tmp": "t", f"r{g}/test_n{k}.py": "", f"r{g}/.env": "K=1"}
    _write(root, files)
    return root


_TREE = """f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, 'source' AS kind, NULL::VARCHAR AS omission FROM nation WHERE n_regionkey <> 3
UNION SELECT 'r' || n_regionkey || '/test_n' || n_nationkey || '.py', 'test', NULL FROM nation WHERE n_regionkey <> 3 UNION SELECT 'r2/n' || n_nationkey || '.tmp', 'other', NULL FROM nation WHERE n_regionkey = 2
UNION SELECT 'r' || r_regionkey || '/.env', 'other', 'excluded path' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) AND r_regionkey <> 3)"""


@query(f"WITH {_TREE} SELECT path, kind, omission FROM f")
def scan_tree(spark, sf_dir):
    """SRC-1, SRC-2, SRC-6: a folder's files without ignored ones, nested rules last; secrets have no text."""
    got = repo.scan(spark, _tree(spark, sf_dir)).where(~F.col("path").endswith(".gitignore"))
    return got.select("path", "kind", "omission")


@query(f"WITH {_TREE} SELECT path, strlen(CASE WHEN kind = 'source' THEN 'x = ' || regexp_extract(path, 'n(\\d+)', 1) || chr(10) WHEN kind = 'test' THEN '' ELSE 't' END)::BIGINT AS size, true AS same FROM f WHERE omission IS NULL")
def scan_fingerprints(spark, sf_dir):
    """SRC-3, SRC-9: equal contents have equal fingerprints, in the tree's manifest too."""
    root = _tree(spark, sf_dir)
    got = repo.scan(spark, root).where(~F.col("path").endswith(".gitignore") & F.col("omission").isNull())
    manifest = _place(spark, "manifest")
    got.select("path", "content_hash").write.json(manifest)
    old = spark.read.schema("path string, content_hash string").json(manifest).withColumnRenamed("content_hash", "old")
    own = F.udf(lambda t: repo.fingerprint(t.encode()), "string", useArrow=True)
    return got.join(old, "path").select("path", F.octet_length("text").cast("long").alias("size"), ((own("text") == F.col("content_hash")) & (F.col("old") == F.col("content_hash"))).alias("same"))


#: A project a nation: its files, and the edges that its references make.
_PROJECT = {
    "pkg/__init__.py": "from .core import Base, helper\n",
    "pkg/core.py": "class Base:\n    def run(self):\n        return helper(1)\n    def stop(self): pass\ndef helper(x):\n    return x\n",
    "pkg/app.py": (
        "import os\nfrom . import core\nfrom .core import Base\nfrom . import helper\nif os:\n    Parent = Base\nelse:\n    Parent = core.Base\nclass App(Parent):\n    def go(self, cb):\n        self.run(); self.own(); super().stop(); os.getcwd(); cb()\n        core.helper(2)\n"
        "    def own(self):\n        return list(map(helper, []))\n    def later(helper):\n        helper()\n"
    ),
    "pkg/body.py": "def make(f): return f\nclass K:\n    def make(self): pass\n    other = make(1)\n",
    "pkg/top.py": "from .app import App\na = App()\na.items()\nwith a:\n    def local_{k}(): pass\nlocal_{k}()\n",
    "pkg/ext.py": "from outer import Outer\nfrom .core import Base\nclass M(Outer, Base):\n    def __enter__(self): pass\nclass N(Outer, M):\n    def t(self):\n        self.__enter__(); self.run()\n",
}
_PROJECT_EDGES = [
    ("pkg/__init__.py", "pkg/core.py", "IMPORTS", 1.0), ("pkg/app.py", "pkg/core.py", "IMPORTS", 1.0), ("pkg/app.py", "pkg/__init__.py", "IMPORTS", 1.0), ("pkg/top.py", "pkg/app.py", "IMPORTS", 1.0), ("pkg/ext.py", "pkg/core.py", "IMPORTS", 1.0),
    ("pkg/app.py::App", "pkg/core.py::Base", "INHERITS", 0.90), ("pkg/ext.py::M", "pkg/core.py::Base", "INHERITS", 0.95), ("pkg/ext.py::N", "pkg/ext.py::M", "INHERITS", 0.90),
    ("pkg/core.py::Base.run", "pkg/core.py::helper", "CALLS", 0.90), ("pkg/app.py::App.go", "pkg/core.py::Base.run", "CALLS", 0.85), ("pkg/app.py::App.go", "pkg/app.py::App.own", "CALLS", 0.90), ("pkg/app.py::App.go", "pkg/core.py::Base.stop", "CALLS", 0.85),
    ("pkg/app.py::App.go", "pkg/core.py::helper", "CALLS", 0.95), ("pkg/app.py::App.own", "pkg/core.py::helper", "REFERENCES", 0.95), ("pkg/body.py::K", "pkg/body.py::K.make", "CALLS", 0.90), ("pkg/top.py", "pkg/app.py::App", "CALLS", 0.95),
    ("pkg/top.py", "pkg/top.py::local_{k}", "CALLS", 0.90), ("pkg/ext.py::N.t", "pkg/ext.py::M.__enter__", "CALLS", 0.60), ("pkg/ext.py::N.t", "pkg/core.py::Base.run", "CALLS", 0.85),
]


def _projects(spark, sf_dir, files: dict[str, str]):
    told = spark.createDataFrame(list(files.items()), "at string, source string")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    out = n.crossJoin(F.broadcast(told)).select(F.concat(F.lit("p"), "k", F.lit("/"), F.col("at")).alias("path"), F.replace("source", F.lit("{k}"), F.col("k")).alias("text"))
    return out.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))


def _project_sql(edges: list[tuple]) -> str:
    rows = ", ".join(f"({', '.join(map(literal, e))})" for e in edges)
    k = "n_nationkey::VARCHAR"
    return f"SELECT 'p' || {k} || '/' || replace(s, '{{k}}', {k}) AS source_key, 'p' || {k} || '/' || replace(t, '{{k}}', {k}) AS target_key, r AS relation, c::DOUBLE AS confidence FROM nation, (VALUES {rows}) e(s, t, r, c)"


@query(_project_sql(_PROJECT_EDGES))
def project_edges(spark, sf_dir):
    """RES-1, RES-5 to RES-9, RES-11, RES-14, RES-16, RES-19, RES-20: every edge of small projects, and no other."""
    files = _projects(spark, sf_dir, _PROJECT)
    return resolve.build_edges(facts.extracted(files), files.select("path"))["edges"].select("source_key", "target_key", "relation", "confidence")


@query("SELECT source_key, target_key, relation, 'unverified' AS resolution_status FROM (" + _project_sql([e for e in _PROJECT_EDGES if e[3] in (0.95, 0.90) and e[2] != "IMPORTS"]) + ")")
def project_syntax_edges(spark, sf_dir):
    """EV-34: what imports and the own module show, unverified."""
    files = _projects(spark, sf_dir, _PROJECT)
    return resolve.syntax_only(resolve.build_edges(facts.extracted(files), files.select("path"))["edges"]).select("source_key", "target_key", "relation", "resolution_status")


_WEB = {
    "web/api.ts": "export function load(u) { return u; }\nexport default class Client {\n  get() { return load({k}); }\n}\n", "web/index.ts": 'export { load as fetchIt } from "./api";\nexport * from "./api";\n',
    "web/app.tsx": 'import Client, { load } from "./api";\nimport { fetchIt } from "./index";\nimport React from "react";\nexport const App = () => { const c = new Client(); load(2); fetchIt(3); React.run(); return <Client x={load}/>; }\n',
}


@query(_project_sql([("web/index.ts", "web/api.ts", "IMPORTS", 1.0), ("web/app.tsx", "web/api.ts", "IMPORTS", 1.0), ("web/app.tsx", "web/index.ts", "IMPORTS", 1.0), ("web/api.ts::Client.get", "web/api.ts::load", "CALLS", 0.90), ("web/app.tsx::App", "web/api.ts::Client", "CALLS", 0.95), ("web/app.tsx::App", "web/api.ts::load", "CALLS", 0.95), ("web/app.tsx::App", "web/api.ts::load", "REFERENCES", 0.95)]))
def project_barrels(spark, sf_dir):
    """RES-3, RES-6, EXT-12, EXT-13: barrels, default exports, JSX tags and values of a TypeScript project."""
    files = _projects(spark, sf_dir, _WEB)
    return resolve.build_edges(facts.extracted(files), files.select("path"))["edges"].select("source_key", "target_key", "relation", "confidence")


_SPECS = [("./x", "web/x.ts", 1.0), ("./y.js", "web/y.ts", 1.0), ("./dir", "web/dir/index.js", 1.0), ("../top", "top.jsx", 1.0), ("../../up", None, None), ("@/x", "web/x.ts", 0.9), ("lib/z", "web/src/lib/z.mjs", 0.9), ("react", None, None), ("@/none", None, None)]


@query("SELECT 'p' || n_nationkey || '/web/use.ts' AS path, s AS spec, 'p' || n_nationkey || '/' || f AS file, c::DOUBLE AS confidence FROM nation, (VALUES " + ", ".join(f"({', '.join(map(literal, s))})" for s in _SPECS if s[1]) + ") t(s, f, c)")
def resolve_javascript_modules(spark, sf_dir):
    """RES-3, RES-4, SRC-7, JN-6: relative specs, twins and indexes, aliases and bases of the nearest config."""
    ks = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").collect()]
    conf = {f"p{k}/web/tsconfig.json": '{"extends": "./base", /* c */ "compilerOptions": {"baseUrl": "src",}}' for k in ks} | {f"p{k}/web/base.json": '{"compilerOptions": {"paths": {"@/*": ["../*"]}}}' for k in ks}
    configs = modules.read_configs(sorted(conf), conf.get)
    # aliases of an extended config start at its own folder
    configs = [{**c, "patterns": [("@/*", [f"{c['folder']}/*"])]} for c in configs]
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("p"))
    told = spark.createDataFrame([(f,) for f in ("web/x.ts", "web/y.ts", "web/dir/index.js", "top.jsx", "web/src/lib/z.mjs")], "f string")
    files = n.crossJoin(F.broadcast(told)).select(F.concat("p", "f").alias("path"))
    imports = n.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s, *_ in _SPECS], "spec string"))).select(F.concat("p", F.lit("web/use.ts")).alias("path"), "spec", F.lit(0).alias("level"))
    return modules.resolve_javascript(imports, files, configs).select("path", "spec", "file", "confidence")


@query("SELECT 'm' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'g' ELSE 'f' END || p_partkey AS name, p_partkey % 3 = 0 AS parsed FROM part WHERE p_partkey % 5 <> 0")
def facts_refreshed(spark, sf_dir):
    """EXT-14: only changed files are parsed again; removed ones are gone."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")

    def files(changed: bool):
        name = F.when((F.col("p_partkey") % 3 == 0) & F.lit(changed), F.lit("g")).otherwise(F.lit("f"))
        code = F.concat(F.lit("def "), name, k, F.lit("(): pass\n"))
        return p.select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), F.sha2(code.cast("binary"), 256).alias("content_hash"), code.alias("text"), "p_partkey")

    # a mark in the stored facts shows which rows are not parsed again
    old = facts.extracted(files(False)).withColumn("default_export", F.lit("stored"))
    new = facts.refreshed(files(True).where("p_partkey % 5 <> 0").drop("p_partkey"), old)
    return new.select("path", F.col("symbols")[0]["name"].alias("name"), F.col("default_export").isNull().alias("parsed"))


@query("SELECT 'p' || n_nationkey || '/a.py::f' AS source_key, 'p' || n_nationkey || '/b.py' AS target_key, (3 + n_nationkey)::BIGINT AS count FROM nation UNION ALL SELECT 'p' || n_nationkey || '/a.py', 'p' || n_nationkey || '/b.py::C.m', 7::BIGINT FROM nation")
def runtime_traces(spark, sf_dir):
    """RES-23: traced lines as edges of the innermost symbols around them."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("p"), F.col("n_nationkey").cast("long").alias("k"))
    a, b = F.concat("p", F.lit("/a.py")), F.concat("p", F.lit("/b.py"))
    call = lambda x, y, c: n.select(a.alias("caller_path"), F.lit(x).alias("caller_line"), b.alias("callee_path"), F.lit(y).alias("callee_line"), c.alias("count"))
    trace = call(3, 50, F.lit(3).cast("long")).union(call(5, 50, F.col("k"))).union(call(40, 12, F.lit(7).cast("long")))
    spans = n.select(a.alias("path"), F.lit(2).alias("first"), F.lit(9).alias("last"), F.lit("f").alias("owner")).union(n.select(b, F.lit(10), F.lit(30), F.lit("C"))).union(n.select(b, F.lit(11), F.lit(13), F.lit("C.m")))
    return resolve.runtime_edges(trace, spans)


# -- paths and lookup -------------------------------------------------------------

_URL = r"regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@query(rf"""WITH u AS (SELECT page_id, {_URL} AS path FROM pages), b AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM u)
SELECT page_id, name, regexp_replace(path, '/?[^/]*$', '') AS folder, CASE WHEN instr(substr(name, 2), '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem, lower(CASE WHEN instr(substr(name, 2), '.') > 0 THEN regexp_extract(name, '\.[^.]*$') ELSE '' END) AS suffix FROM b""")
def path_parts(spark, sf_dir):
    """Names, folders, stems and suffixes of paths."""
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path"))
    return u.select("page_id", base_name("path").alias("name"), folder("path").alias("folder"), stem("path").alias("stem"), suffix("path").alias("suffix"))


_FILES = r"files AS (SELECT regexp_extract(url, '^[^:]*://(.*)$', 1) AS path, CASE WHEN page_id % 3 = 0 THEN 'test' ELSE 'source' END AS kind FROM pages)"


@query(f"WITH {_SYM}, t AS (SELECT min(file_path) AS f, min(name) AS n FROM sym) SELECT node_key, file_path FROM sym, t WHERE name = n AND file_path = f UNION ALL SELECT url, url FROM (SELECT min(regexp_extract(url, '^[^:]*://(.*)$', 1)) AS url FROM pages)")
def targets_resolved(spark, sf_dir):
    """FLT-4: a file of that very path, or symbols in a given file."""
    s, f = star.symbols(spark, sf_dir), star.files(spark, sf_dir)
    first = s.agg(F.min("file_path").alias("f"), F.min("name").alias("n")).first()
    path = f.agg(F.min("path")).first()[0]
    one = lookup.resolve_targets(s, f, first["n"], first["f"]).select("node_key", "file_path")
    return one.union(lookup.resolve_targets(s, f, path).select("node_key", "file_path").distinct())


@query(f"WITH {_SYM}, h AS (SELECT * FROM sym WHERE contains(lower(name), 'ea') AND NOT EXISTS (SELECT 1 FROM sym WHERE name = 'ea')) SELECT node_key, count(*) OVER () > 10 AS ambiguous FROM (SELECT * FROM h ORDER BY file_path, start_line, node_key LIMIT 11)")
def targets_ambiguous(spark, sf_dir):
    """FLT-5: one more than ten targets tell that a name is ambiguous."""
    found = lookup.matching(star.symbols(spark, sf_dir), star.files(spark, sf_dir), "ea").select("node_key")
    return found.withColumn("ambiguous", F.lit(found.count() > lookup.AMBIGUOUS))


@query("SELECT 'part::' || p_partkey AS node_key FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING min(p_size) > 3)")
def symbols_in_scope(spark, sf_dir):
    """FLT-7, JN-9: symbols whose file is of a kind."""
    p = table(spark, sf_dir, "part")
    kinds = p.groupBy(F.concat_ws("/", F.lit("src"), "p_brand").alias("path")).agg(F.when(F.min("p_size") > 3, "test").otherwise("source").alias("kind"))
    return lookup.in_scope(star.symbols(spark, sf_dir), kinds, "test").select("node_key")


@query("SELECT count(*)::BIGINT AS n, count(*) > 50 AS refused FROM nation")
def rows_bounded(spark, sf_dir):
    """FLT-11: more rows than the bound are an error, and nothing is cut."""
    n = table(spark, sf_dir, "nation")
    try:
        lookup.bounded(n, n.count() - 1)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(lookup.bounded(n, n.count()).count(), not refused)], "n long, refused boolean")


@query(r"SELECT page_id, page_id % 4 IN (0, 1) AS secret FROM pages")
def secret_paths(spark, sf_dir):
    """FLT-12: paths that are never evidence."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/"), F.element_at(F.array(F.lit(".env.local"), F.lit("keys/id.pem"), F.lit("src/env.py"), F.lit("pem/readme.md")), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    return p.select("page_id", secret_path("path").alias("secret"))


@query("SELECT 'stale' AS state, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0)::BIGINT AS added, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 1)::BIGINT AS removed, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 2)::BIGINT AS changed UNION ALL SELECT 'ready', 0, 0, 0 UNION ALL SELECT 'not_indexed', 0, 0, 0 UNION ALL SELECT 'invalid', 0, 0, 0")
def index_health(spark, sf_dir):
    """FLT-15: what an index is worth against its tree."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.lit("source").alias("kind"), F.col("n_nationkey"))
    old = n.where("n_nationkey % 5 <> 0").select("path", "kind", F.lit("1").alias("content_hash"))
    new = n.where("n_nationkey % 5 <> 1").select("path", "kind", F.when(F.col("n_nationkey") % 5 == 2, "2").otherwise("1").alias("content_hash"))
    told = [lookup.health(old, new), lookup.health(old, old), lookup.health(None, new), lookup.health(old, old, (1,), (2,))]
    return spark.createDataFrame([(h["state"], len(h["added"]), len(h["removed"]), len(h["changed"])) for h in told], "state string, added long, removed long, changed long")


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey AS key, k <= 30 AS first_page FROM c WHERE k <= 60")
def pages_by_cursor(spark, sf_dir):
    """TK-3, PK-4, FLT-14: a page, its cursor, and the next page; pages stop where bytes end."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    files = star.files(spark, sf_dir)
    one = lookup.execute(c, ["key"], files, "g", "customers", {}, limit=30)
    two = lookup.execute(c, ["key"], files, "g", "customers", {}, limit=30, at=one.next_cursor)
    small_page = lookup.execute(c, ["key"], files, "g", "customers", {}, limit=30, max_bytes=60)
    assert small_page.limit_reason == "bytes" and 0 < len(small_page.items) < 30 and one.limit_reason == "limit"
    return spark.createDataFrame([(r["key"], page is one) for page in (one, two) for r in page.items], "key long, first_page boolean")


@query(f"WITH {_EDGES} SELECT 'out' AS side, t AS node_key, r AS relation FROM e WHERE s = 'customer::7' UNION ALL SELECT 'in', s, r FROM e WHERE t = 'part::7' AND status = 'resolved'")
def adjacency(spark, sf_dir):
    """GR-3, FLT-8: edges along or against their direction, candidate ones if asked for."""
    e = star.published(spark, sf_dir)
    out = graph._steps(E.chosen(e, candidates=True), False).where("at = 'customer::7'").select(F.lit("out").alias("side"), F.col("to").alias("node_key"), "relation")
    return out.union(graph._steps(E.chosen(e), True).where("at = 'part::7'").select(F.lit("in"), "to", "relation"))


@query(f"WITH {_EDGES}, y AS (SELECT s AS a, t AS b, r, c FROM e WHERE status = 'resolved') SELECT node_key, distance::INT AS distance, row_number() OVER (ORDER BY distance, confidence DESC, node_key)::INT AS place FROM (SELECT a AS node_key, 1 AS distance, max(c) AS confidence FROM y WHERE b = 'part::7' GROUP BY a UNION ALL SELECT z.a, 2, max(z.c * y.c) FROM y JOIN y z ON z.b = y.a WHERE y.b = 'part::7' AND z.a NOT IN (SELECT a FROM y WHERE b = 'part::7') AND z.a <> 'part::7' GROUP BY z.a)")
def reach_ordered(spark, sf_dir):
    """TK-1: nearest first, then the surest, then by key."""
    got = graph.reach(star.published(spark, sf_dir), keys(spark, "part::7"), 2, True)
    rows = lookup.page(got, [F.col("distance"), F.col("confidence").desc(), F.col("node_key")], 0, 10**6)
    return rows.select("node_key", "distance", F.col("position").alias("place"))


@query("SELECT true AS truncated, 0::BIGINT AS items, 'edges' AS reason UNION ALL SELECT false, (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey = 7)::BIGINT, NULL")
def reach_limited(spark, sf_dir):
    """GR-15: beyond its limits of work a question has no items and says so.

    The one for regions walks CONTAINS alone; a nation's suppliers, who grow with the tables, are not asked for.
    """
    e = star.published(spark, sf_dir)
    small_, large = (graph.limited(e, keys(spark, k), 1, True, **how) for k, how in (("nation::7", {"relations": ("CONTAINS",)}), ("part::7", {"most_edges": 1})))
    count = lambda w: 0 if w.frame is None else w.frame.where("node_key LIKE 'region::%'").count()
    return spark.createDataFrame([(w.reason is not None, count(w), w.reason) for w in (small_, large)], "truncated boolean, items long, reason string")


# -- evidence and vectors -----------------------------------------------------------


@query("SELECT source AS path, count(*)::BIGINT AS n FROM documents WHERE lang = 'en' AND doc_id % 7 <> 0 GROUP BY source")
def evidence_joined(spark, sf_dir):
    """JN-13: chunks in scope whose file is evidence."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.lit("h").alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "binary").alias("omission"))
    chunks = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "en", "doc").otherwise("test").alias("scope"), "source")
    return text.evidence(chunks, files, ("doc",)).groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n"))


@query(f"WITH {_SYM}, e AS (SELECT DISTINCT file_path AS f, start_line AS a, start_line + 5 AS b FROM sym WHERE start_line <= 10), l AS (SELECT 'src/' || p_brand AS f, p_size + 1 AS a, p_size + 3 AS b, p_partkey AS k FROM part WHERE p_partkey <= 60) SELECT l.k::INT AS place FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.f = l.f AND l.a >= e.a AND l.b <= e.b)")
def evidence_merged(spark, sf_dir):
    """TX-6, JN-18: lexical chunks that an exact span holds are not told twice."""
    exact = star.symbols(spark, sf_dir).where("start_line <= 10").select("file_path", "start_line", "end_line")
    p = table(spark, sf_dir, "part").where("p_partkey <= 60")
    lexical = p.select(F.concat_ws("/", F.lit("src"), "p_brand").alias("path"), (F.col("p_size") + 1).alias("start_line"), (F.col("p_size") + 3).alias("end_line"), F.col("p_partkey").cast("int").alias("position"))
    return text.merged(exact, lexical, 10**6).where("reason = 'lexical'").select("place")


@query(f"WITH {_SYM}, t AS (SELECT min(qualified_name) AS q, min(name) AS n, max(file_path) AS f FROM sym), x AS (SELECT q AS v FROM t UNION SELECT n FROM t UNION SELECT f FROM t UNION SELECT 'nowhere') SELECT v AS target, count(s.node_key)::BIGINT AS n FROM x LEFT JOIN sym s ON s.qualified_name = v OR s.name = v OR s.file_path = v GROUP BY v")
def exact_targets(spark, sf_dir):
    """TX-5: targets by qualified name, name or file; what is none of them is missing."""
    s = star.symbols(spark, sf_dir)
    r = s.agg(F.min("qualified_name").alias("q"), F.min("name").alias("n"), F.max("file_path").alias("f")).first()
    none = spark.createDataFrame([], "path string, start_line int, end_line int")
    found, missing = text.exact_tier(s, none, spark.createDataFrame([(r["q"],), (r["n"],), (r["f"],), ("nowhere",)], "target string"))
    return found.groupBy("target").agg(F.count("*").alias("n")).union(missing.select("target", F.lit(0).cast("long")))


@query("SELECT doc_id, array_to_string((string_split(text, chr(10)))[2:3], chr(10)) AS head FROM documents WHERE doc_id <= 40 AND doc_id % 2 = 0 AND len(string_split(text, chr(10))) >= 2")
def ranges_read(spark, sf_dir):
    """TX-8: exact lines of a text whose hash is the expected one, and nothing of another."""
    d = table(spark, sf_dir, "documents").where("doc_id <= 40")
    texts = d.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text")
    rows = None
    for r in texts.select("path", "content_hash").collect():
        wanted = r["content_hash"] if int(r["path"]) % 2 == 0 else "another"
        one = text.read_range(texts, r["path"], 2, 3, wanted)
        rows = one if rows is None else rows.union(one)
    return rows.where("text <> ''").select(F.col("path").cast("long").alias("doc_id"), F.regexp_replace("text", r"\n$", "").alias("head"))


@query("WITH p AS (SELECT CASE n_regionkey WHEN 0 THEN '' ELSE 'r' || n_regionkey || '/' END AS f FROM nation) SELECT DISTINCT f || 'AGENTS.md' AS path FROM p")
def instruction_paths(spark, sf_dir):
    """TK-9, TX-9: instruction files in the folders above paths, the first twenty."""
    n = table(spark, sf_dir, "nation")
    at = F.when(F.col("n_regionkey") == 0, F.lit("")).otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/")))
    paths = n.select(F.concat(at, F.lit("sub/x.py")).alias("path"))
    files = n.select(F.concat(at, F.lit("AGENTS.md")).alias("path")).union(n.select(F.concat(F.lit("other"), F.col("n_nationkey").cast("string"), F.lit("/AGENTS.md"))))
    return spark.createDataFrame([(p,) for p in text.instruction_files(paths, files)], "path string")


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id <= 200")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("lang") == "en", "doc").otherwise("config").alias("scope"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("H")).alias("heading"), F.substring("source", 1, 40).alias("body"))


@query("SELECT 'd' || doc_id AS path, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || 'H' END || chr(10) || left(source, 40) AS input, sha256('d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || 'H' END || chr(10) || left(source, 40)) AS key FROM documents WHERE doc_id <= 200 AND lang = 'en'")
def embedding_inputs(spark, sf_dir):
    """VC-2: what is embedded of chunks, with its digest."""
    return vector.inputs(_chunks(spark, sf_dir)).select("path", "input", "key")


def _encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


@query("SELECT 'd' || doc_id AS path, doc_id % 3 = 0 AS reused, round(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE x / sqrt(x * x + 1) END, 6) AS first FROM (SELECT *, strlen('d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || 'H' END || chr(10) || left(source, 40))::DOUBLE AS x FROM documents WHERE doc_id <= 200 AND lang = 'en')")
def vectors_refreshed(spark, sf_dir):
    """VC-3, VC-8, JN-12: stored vectors are taken over, the rest is embedded, and chunks meet them by key."""
    inputs = vector.inputs(_chunks(spark, sf_dir))
    stored = inputs.where(F.expr("substring(path, 2)").cast("long") % 3 == 0).select("key", F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    found = vector.keyed(inputs, vector.refreshed(inputs, stored, _encoder, 2))
    return found.select("path", (F.col("vector")[0] == 0).alias("reused"), F.round(F.col("vector")[0], 6).alias("first"))


@query("SELECT * FROM (VALUES ('ready', 'lexical+semantic'), ('stale', 'lexical'), ('busy', 'lexical'), ('disabled', 'lexical'), ('corrupt', 'lexical')) t(state, reason)")
def vectors_fall_back(spark, sf_dir):
    """VC-6, JN-16: without fresh and whole vectors words alone decide, and the state says why."""
    e = table(spark, sf_dir, "embeddings").limit(5).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    wanted, lexical = {"model": "m", "size": 64}, e.select("id", F.lit(1.0).alias("score"))
    broken = e.withColumn("vector", F.transform("vector", lambda x: F.lit(float("nan")).cast("float")))
    told = [(wanted, e, e), (wanted, e.union(e.select((F.col("id") + 10**6), "vector")), e), ({**wanted, "building": True}, e, e), (None, None, e), (wanted, broken, e)]
    out = []
    for meta, stored, current in told:
        state = vector.semantic_state(meta, wanted, stored, current, ["id"])
        rows, why = vector.ranked(state, lambda: lexical, lexical, "id")
        out.append((why, rows.first()["reason"]))
    return spark.createDataFrame(out, "state string, reason string")


@query("WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation), o AS (SELECT k, CASE WHEN k % 10 = 0 THEN 0 WHEN k = 7 THEN 1 WHEN k = 2 THEN 2 ELSE 3 END AS rank, p FROM n) SELECT k::BIGINT AS k, row_number() OVER (ORDER BY rank, p)::INT AS place, 'ready' AS state FROM o UNION ALL SELECT k::BIGINT, row_number() OVER (ORDER BY CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END, p)::INT, 'fallback' FROM o")
def helper_orders(spark, sf_dir):
    """VC-9: exact items, then those that a helper chose, then the rest; a wrong answer changes nothing."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.when(F.col("n_nationkey") % 10 == 0, "exact").otherwise("lexical").alias("reason"))
    items = lookup.page(n, [F.col("k")], 0, 100).withColumnRenamed("position", "place")
    good, state = vector.helper_order(items, lambda texts: [texts.index("7"), texts.index("2")], F.col("k").cast("string"))
    bad, other = vector.helper_order(items, lambda texts: [0, 0], F.col("k").cast("string"))
    return good.select("k", "place", F.lit(state).alias("state")).union(bad.select("k", "place", F.lit(other)))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'stored' ELSE 'read' END AS origin FROM documents WHERE doc_id <= 100 AND text <> '' AND doc_id % 4 IN (1, 2, 3)")
def chunks_kept(spark, sf_dir):
    """TX-3: chunks of unchanged texts are taken over; those of changed and new ones are read, those of removed ones gone."""
    d = table(spark, sf_dir, "documents").where("doc_id <= 100 AND text <> ''")
    rows = d.select(F.col("doc_id").cast("string").alias("path"), F.lit("source").alias("scope"), F.when(F.col("doc_id") % 4 == 2, "new").otherwise("same").alias("content_hash"), "text", "doc_id")
    before = text.chunks_refreshed(rows.where("doc_id % 4 IN (0, 1, 2)").withColumn("content_hash", F.lit("same")), None).withColumn("heading", F.lit("stored"))
    after = text.chunks_refreshed(rows.where("doc_id % 4 IN (1, 2, 3)"), before)
    return after.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.when(F.max("heading") == "stored", "stored").otherwise("read").alias("origin"))


@query("SELECT DISTINCT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(w, lambda x: list_position(w, x)))), lambda p: w[p]), ' ') AS terms FROM (SELECT doc_id, (regexp_extract_all(lower(text), '[a-z]+'))[1:40] AS w FROM documents)")
def terms_in_order(spark, sf_dir):
    """ST-6: distinct arguments in the order of their first place."""
    w = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(w), " ").alias("terms"))


# -- sinks and sources --------------------------------------------------------------


@query("SELECT 'part::' || p_partkey AS source_key, CASE WHEN p_size % 3 = 1 THEN 'removed' WHEN p_size % 3 = 2 THEN 'changed' ELSE 'added' END AS change FROM part")
def edges_differ(spark, sf_dir):
    """SNK-4: what a new set of edges deletes, changes and adds."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("source_key"), F.lit("t").alias("target_key"), F.lit("CALLS").alias("relation"), F.lit(0.9).alias("confidence"), "p_size")
    old = p.where("p_size % 3 IN (1, 2)")
    new = p.where("p_size % 3 IN (0, 2)").withColumn("confidence", F.lit(0.95))
    return E.difference(old, new, E.KEY, ["confidence"]).select("source_key", "change")


@query("SELECT (SELECT count(*) FROM region)::BIGINT AS symbols, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey)::BIGINT AS edges, true AS sorted")
def graph_exported(spark, sf_dir):
    """SNK-5: sorted JSON of symbols, and of edges between them."""
    s = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_key"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    e = n.select(key.alias("source_key"), key.alias("target_key"), F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("relation"))
    e = e.union(n.select(key, F.lit("nowhere"), F.lit("CALLS")))
    path = _place(spark, "export")
    snapshot.export(s, e, path, "repo", "sha")
    rows = [r["node_key"] for r in spark.read.json(f"{path}/symbols").select("node_key", F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
    return spark.createDataFrame([(len(rows), spark.read.json(f"{path}/edges").count(), rows == sorted(rows))], "symbols long, edges long, sorted boolean")


@query("SELECT '# Nations' || chr(10) || chr(10) || '| n_name | n_nationkey |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' ELSE n_nationkey::VARCHAR END || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS report FROM nation")
def markdown_report(spark, sf_dir):
    """SNK-9: a table whose nulls are unknown, never zero."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey")).alias("n_nationkey")).collect()
    return spark.createDataFrame([(snapshot.markdown([r.asDict() for r in rows], ["n_name", "n_nationkey"], "Nations"),)], "report string")


@query("SELECT '<!doctype html><meta charset=utf-8><title>A &amp; B</title><h1>A &amp; B</h1><table><tr><th>r_name</th></tr>' || string_agg('<tr><td>&lt;' || r_name || '&gt;</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS page FROM region")
def html_dashboard(spark, sf_dir):
    """SNK-8: one page of escaped cells."""
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.concat(F.lit("<"), "r_name", F.lit(">")).alias("r_name")).collect()
    return spark.createDataFrame([(snapshot.dashboard([r.asDict() for r in rows], ["r_name"], "A & B"),)], "page string")


@query("SELECT c_custkey, c_name FROM customer")
def csv_written(spark, sf_dir):
    """SNK-11: rows as CSV with a header, read back."""
    path = _place(spark, "csv")
    reports.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return spark.read.option("header", True).schema("c_custkey long, c_name string").csv(path)


@query("SELECT c_custkey AS session_id FROM customer WHERE c_custkey % 4 IN (0, 3)")
def attempts_pending(spark, sf_dir):
    """SNK-10: what of a schedule is left: no valid attempt, and fewer than two."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    made = c.where("session_id % 4 = 1").select("session_id", F.lit(True).alias("valid")).union(c.where("session_id % 4 IN (2, 3)").select("session_id", F.lit(False))).union(c.where("session_id % 4 = 2").select("session_id", F.lit(False)))
    return reports.pending(c, made)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_nationkey / 2.0::DOUBLE AS half FROM nation")
def sqlite_rows(spark, sf_dir):
    """SRC-10: a table of a SQLite file, read only and in splits."""
    root = _mounted(spark, "sqlite")
    os.makedirs(root, exist_ok=True)
    with sqlite3.connect(f"{root}/t.db") as c:
        c.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, half REAL)")
        c.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r["n_nationkey"], r["n_name"], r["n_nationkey"] / 2) for r in table(spark, sf_dir, "nation").collect()])
    c.close()
    spark.dataSource.register(small.SqliteSource)
    return spark.read.format("sqlite").option("path", f"{root}/t.db").option("table", "nation").load()


@query("SELECT n_name AS name, 5::BIGINT AS tests, (n_nationkey % 3)::BIGINT AS failures, 0::BIGINT AS errors, 0::BIGINT AS skipped FROM nation")
def junit_suites(spark, sf_dir):
    """SRC-16: suites of JUnit XML."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    root = _place(spark, "junit")
    xml = "<testsuites>" + "".join(f'<testsuite name="{r["n_name"]}" tests="5" failures="{r["n_nationkey"] % 3}" errors="0"></testsuite>' for r in n) + "</testsuites>"
    spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(root)
    return transcripts.junit(spark, root)


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS symbols, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS files")
def symbol_counts(spark, sf_dir):
    """AG-2"""
    return star.symbols(spark, sf_dir).agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))


# -- graphs against others, ledgers, sessions -------------------------------------------


@query("""WITH m AS (SELECT p_partkey AS k, p_partkey % 5 AS z FROM part) SELECT p.k::BIGINT AS their_id, CASE WHEN z = 0 THEN NULL ELSE p.k + 1000000 END::BIGINT AS our_id, CASE WHEN z = 0 THEN 'unmapped' WHEN z = 1 THEN 'unique' ELSE 'exact' END AS mapping FROM m p""")
def symbols_mapped(spark, sf_dir):
    """JN-15: symbols of another graph by exact name, else by a last segment that is unique in its file."""
    theirs, ours = _graphs(spark, sf_dir)
    return evaluate.mapped(theirs, ours)


def _graphs(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    z = F.col("p_partkey") % 5
    file, name = F.concat(F.lit("f"), k), F.concat(F.lit("m"), k)
    theirs = p.select(F.col("p_partkey").cast("long").alias("id"), file.alias("file"), F.concat(F.lit("A."), name).alias("qualname"))
    held = F.when(z == 1, "B.").otherwise("A.")
    ours = p.where(z != 0).select((F.col("p_partkey") + 1000000).cast("long").alias("id"), file.alias("file"), F.concat(held, name).alias("qualname"))
    return theirs, ours


@query("WITH t AS (SELECT p_partkey AS s, p_partkey + 1 AS t FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)), g AS (SELECT s, t FROM t WHERE s % 5 <> 0 AND t % 5 <> 0), o AS (SELECT p_partkey AS s, p_partkey + 1 AS t FROM part WHERE p_partkey % 5 IN (1, 2) UNION SELECT p_partkey, p_partkey + 3 FROM part WHERE p_partkey % 5 = 1) SELECT (SELECT count(*) FROM g JOIN o USING (s, t))::BIGINT AS tp, (SELECT count(*) FROM o ANTI JOIN g USING (s, t))::BIGINT AS fp, (SELECT count(*) FROM g ANTI JOIN o USING (s, t))::BIGINT AS fn, (SELECT count(*) FROM t WHERE s % 5 = 0 OR t % 5 = 0)::BIGINT AS unmapped")
def graphs_compared(spark, sf_dir):
    """EV-15: pairs of symbols of two graphs after mapping."""
    a, b = _graphs(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    theirs = p.select(F.col("k").alias("source"), (F.col("k") + 1).alias("target")).join(p.select(F.col("k").alias("target")), "target", "left_semi").select("source", "target")
    up = F.col("k") + 1000000
    ours = p.where("k % 5 IN (1, 2)").select(up.alias("source"), (up + 1).alias("target")).union(p.where("k % 5 = 1").select(up, up + 3))
    return evaluate.compare_pairs(theirs, ours, a, b).select("tp", "fp", "fn", "unmapped")


_JUDGED = f"""WITH {_EDGES}, ours AS (SELECT s, t, status FROM e WHERE r = 'CALLS' AND t LIKE 'part::%'), pairs AS (SELECT DISTINCT 'orders::' || l_orderkey AS s, 'part::' || l_partkey AS t, l_orderkey + l_partkey AS z FROM lineitem),
oracle AS (SELECT s, t, CASE WHEN z % 4 = 0 THEN 'type_declared' ELSE 'binding' END AS basis FROM pairs WHERE z % 3 <> 0 UNION ALL SELECT 'x', 'part::' || p_partkey, 'binding' FROM part WHERE p_partkey % 10 = 0)"""


def _judged(spark, sf_dir):
    """Edges of orders and parts, and an oracle that knows two thirds of them and some more."""
    ours = star.published(spark, sf_dir).where("relation = 'CALLS' AND target_key LIKE 'part::%'").select(F.col("source_key").alias("source"), F.col("target_key").alias("target"), "resolution_status")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    z = F.col("l_orderkey") + F.col("l_partkey")
    known = line.where(z % 3 != 0).select(F.concat(F.lit("orders::"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("target"), F.when(z % 4 == 0, "type_declared").otherwise("binding").alias("basis"))
    return ours, known.union(table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.lit("x"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")), F.lit("binding")))


@query(f"""{_JUDGED}, claims AS (SELECT 'part::' || p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND 'part::' || p_partkey NOT IN (SELECT t FROM ours WHERE status = 'resolved' AND s LIKE '%7')), f AS (SELECT t AS id, bool_or(basis = 'binding') AS bound FROM oracle GROUP BY t),
j AS (SELECT * FROM claims LEFT JOIN f USING (id)) SELECT count(*)::BIGINT AS claims, count(bound)::BIGINT AS wrong, (count(*) FILTER (bound))::BIGINT AS bound, round(count(bound) / count(*), 4) AS false_claim_rate, (count(bound) - count(*) FILTER (bound))::BIGINT AS type_declared_only FROM j""")
def unused_symbols_judged(spark, sf_dir):
    """EV-18: claims that a symbol has no use, and those that an oracle refutes."""
    ours, oracle = _judged(spark, sf_dir)
    symbols = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"))
    return evaluate.unused_claims(symbols, ours.where("source LIKE '%7'"), oracle)


@query(f"""{_JUDGED}, a AS (SELECT s, t, bool_or(status = 'resolved') AS r, bool_or(status = 'candidate') AS c FROM ours GROUP BY s, t), b AS (SELECT s, t, bool_or(basis <> 'type_declared') AS o FROM oracle GROUP BY s, t),
j AS (SELECT coalesce(r, false) AS r, coalesce(c, false) AS c, o IS NOT NULL AS k, coalesce(o, false) AS o FROM a FULL JOIN b USING (s, t) WHERE t LIKE '%0'), n AS (SELECT count(*) FILTER (r) AS re, count(*) FILTER (r AND k) AS rt, count(*) FILTER (c) AS ce, count(*) FILTER (c AND k) AS ct, count(*) FILTER (k) AS oe, count(*) FILTER (o) AS su, count(*) FILTER (o AND r) AS hit, count(*) FILTER (o AND NOT r AND c) AS mc, count(*) FILTER (o AND NOT r AND NOT c) AS me FROM j)
SELECT re::BIGINT AS resolved_edges, rt::BIGINT AS resolved_tp, ce::BIGINT AS candidate_edges, ct::BIGINT AS candidate_tp, oe::BIGINT AS oracle_edges, su::BIGINT AS supported, mc::BIGINT AS missed_but_candidate, me::BIGINT AS missed_entirely, round(rt / re, 4) AS resolved_precision, round(ct / ce, 4) AS candidate_precision, round(hit / su, 4) AS supported_recall FROM n""")
def hard_case_slices(spark, sf_dir):
    """EV-18: precision and supported recall of a slice of the pairs."""
    return evaluate.hard_cases(*_judged(spark, sf_dir), F.col("target").endswith("0"))


@query("SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'unclear' WHEN c_custkey % 3 = 1 THEN 'true' ELSE 'false' END AS verdict FROM customer WHERE c_custkey % 7 <> 0) GROUP BY verdict")
def edges_adjudicated(spark, sf_dir):
    """EV-23, EV-30: one verdict an edge; edges with two are unclear, unknown verdicts are left out."""
    c = table(spark, sf_dir, "customer").select(F.lit("sha").alias("repo_sha"), F.col("c_custkey").cast("string").alias("source_key"), F.lit("t").alias("target_key"), F.lit("CALLS").alias("relation"), F.when(F.col("c_custkey") % 7 == 0, "maybe").when(F.col("c_custkey") % 3 == 2, "false").otherwise("true").alias("verdict"), F.lit("x").alias("category"), "c_custkey")
    twice = c.where("c_custkey % 3 = 0 AND c_custkey % 7 <> 0").withColumn("verdict", F.lit("false"))
    return evaluate.adjudicated(c.union(twice).drop("c_custkey")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM part WHERE p_brand < 'Brand#30')::BIGINT AS symbols, (SELECT count(*) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand < 'Brand#30' AND b.p_brand < 'Brand#30')::BIGINT AS edges")
def graph_of_files(spark, sf_dir):
    """EV-28: symbols of included files and edges with both ends among them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    edges = p.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    s, e = evaluate.manifest_filter(p, edges, p.where("file < 'Brand#30'").select("file").distinct())
    return s.agg(F.count("*").alias("symbols")).crossJoin(e.agg(F.count("*").alias("edges")))


@query("SELECT (l_orderkey % 10)::VARCHAR AS source, l_orderkey % 4 = 0 AS hit, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def runtime_matches(spark, sf_dir):
    """GR-17: a call of a class's __init__ is hit by an edge to the class."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("source"), "l_orderkey", F.monotonically_increasing_id().alias("id"))
    run = line.select("source", F.concat(F.lit("s"), "source").alias("source_key"), F.concat(F.lit("C"), (F.col("l_orderkey") % 4).cast("string"), F.lit(".__init__")).alias("target_key"), F.lit(1).cast("long").alias("count"))
    static = run.select("source_key", F.lit("C0").alias("target_key"), F.lit("resolved").alias("resolution_status")).distinct()
    out = None
    for s in range(10):
        one = evaluate.accounted(run.where(F.col("source") == str(s)), static).select(F.lit(str(s)).alias("source"), (F.col("part") == "resolved").alias("hit"), F.col("n_calls").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("WITH e AS (SELECT coalesce(CASE WHEN event_id % 3 = 0 THEN 'o' || event_id % 50 END, 'c' || event_id % 200) AS identity, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'ok' END AS status FROM events) SELECT identity, count(*)::BIGINT AS n_calls, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources, CASE WHEN bool_and(status = 'unknown') THEN 'unknown' ELSE 'ok' END AS status FROM e GROUP BY identity")
def observations_merged(spark, sf_dir):
    """LG-4: calls of one observation are one, whatever ids their clients gave them."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 200).cast("string")).alias("call_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("o"), (F.col("event_id") % 50).cast("string"))).alias("observation_id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 == 0, "unknown").otherwise("ok").alias("status"), F.array("event_type").alias("sources"), F.col("event_id").alias("seq"))
    return observe.identities(e).select("identity", "n_calls", F.array_join("sources", ",").alias("sources"), "status")


@query("SELECT 'find' AS tool, 'invoked' AS phase, NULL AS status, NULL::BIGINT AS result_count, 3::BIGINT AS n UNION ALL SELECT 'find', 'completed', 'ok', (SELECT count(*) FROM region)::BIGINT, 2 UNION ALL SELECT 'find', 'completed', 'KeyError', NULL, 1")
def requests_observed(spark, sf_dir):
    """LG-19, SRC-14: two records a request in an appended ledger, failed ones too."""
    path, seen = _place(spark, "ledger"), observe.Observer(lambda: "g")
    items = [r["r_name"] for r in table(spark, sf_dir, "region").collect()]
    for _ in range(2):
        seen.call("find", lambda: {"items": items, "truncated": False})
    seen.append(spark, path)
    try:
        seen.call("find", lambda: {}["none"])
    except KeyError:
        pass
    seen.append(spark, path)
    return spark.read.parquet(path).groupBy("tool", "phase", "status", "result_count").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS session, CASE WHEN c_custkey % 3 = 0 THEN 'none' WHEN c_custkey % 3 = 1 THEN 'current' ELSE 'stale' END AS label_state, CASE WHEN c_custkey % 3 = 1 THEN 'good' END AS label FROM customer")
def labels_versioned(spark, sf_dir):
    """LG-16, SM-9: a label is good for the snapshot that it was given to."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.lit("k1").alias("snapshot_key"))
    labels = c.where("session % 3 <> 0").select("session", F.when(F.col("session") % 3 == 1, "k1").otherwise("old").alias("snapshot_key"), F.lit("good").alias("label"))
    return logs.labelled(c, labels).select("session", "label_state", "label")


@query("SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, median(c_acctbal) AS median_balance, count(*) FILTER (c_acctbal IS NULL)::BIGINT AS missing_balance, median(c_acctbal) FILTER (c_nationkey % 2 = 0) AS median_passed_balance FROM customer GROUP BY 1")
def cohorts_compared(spark, sf_dir):
    """LG-10, LG-11: exact medians a cohort, over all and over those that passed; one report a session."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    return logs.cohorts(logs.distinct_sessions(c), ["segment"], ["balance"], F.col("c_nationkey") % 2 == 0)


@query("SELECT user_id::VARCHAR AS session, count(*) FILTER (event_id % 5 <> 0)::BIGINT AS n_events, count(*) FILTER (event_id % 5 = 0)::BIGINT AS n_children FROM events GROUP BY user_id")
def stream_child_events(spark, sf_dir):
    """SM-6, SM-7: events of child sessions are counted apart by the running fold."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    null = lambda t: F.lit(None).cast(t)
    events = source.select(F.col("user_id").cast("string").alias("session"), F.lit("a").alias("client"), F.col("event_id").alias("seq"), F.lit("other").alias("kind"), null("string").alias("message_id"), null("string").alias("call_id"), null("long").alias("total_tokens"), (F.col("event_id") % 5 == 0).alias("sidechain"))
    path = _place(spark, "watch")
    q = fold.watch(events, path)
    q.awaitTermination()
    return spark.read.parquet(f"{path}/reports/v=0").select("session", "n_events", "n_children")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+'))::BIGINT > 0 AS told FROM documents WHERE doc_id <= 30")
def index_kept_fresh(spark, sf_dir):
    """SM-10, RES-21: a tree is scanned, asked, changed and asked again; a change of documents leaves the edges as they are."""
    from graphloom.api import Engine

    d = table(spark, sf_dir, "documents").where("doc_id <= 30").select("doc_id", "text").collect()
    root = _mounted(spark, "fresh")
    _write(root, {"a.py": "def a(): return b()\ndef b(): pass\n"} | {f"docs/d{r['doc_id']}.md": r["text"] or "" for r in d})
    engine = Engine(spark, _place(spark, "index"))
    engine.scan(root)
    _write(root, {"docs/new.md": "# New\n"})
    kept = engine.scan(root)["edges_kept"]
    told = engine.fresh(root, lambda e: {r["path"] for r in e._table("chunks").select("path").distinct().collect()})
    assert kept and "docs/new.md" in told and engine.callers("b").items[0]["name"] == "a"
    return spark.createDataFrame([(r["doc_id"], f"docs/d{r['doc_id']}.md" in told) for r in d], "doc_id long, told boolean")


@query("SELECT 2::BIGINT AS made, (SELECT count(*) FROM region)::BIGINT AS kept, true AS same")
def packets_cached(spark, sf_dir):
    """SNK-6: packets by generation, query, place and budget; the least recently used go first."""
    n, made = table(spark, sf_dir, "region").count(), []
    cache = pack.Packets(n)
    for i in range(n):
        cache.get(("g", i), lambda i=i: {"i": i})
    # a new packet pushes out the second one, as the first was asked for again
    for key in (0, "new", 0, 1, "new"):
        cache.get(("g", key), lambda key=key: made.append(key) or {"i": key})
    again = cache.get(("g", 0), dict)["i"] == 0
    return spark.createDataFrame([(len(made), len(cache.kept), again)], "made long, kept long, same boolean")


@query("SELECT 5.0::DOUBLE AS full, 0.1::DOUBLE AS idle, 1.0::DOUBLE AS one_file, 5.0::DOUBLE AS ratio, true AS passed UNION ALL SELECT 2.0, 0.1, 1.0, 2.0, false")
def scan_timings(spark, sf_dir):
    """EV-33: medians of scan times and the gate of their ratio."""
    out = [timing.ratios([4.0, 6.0, 5.0], [0.1], [1.0, 0.5, 9.0]), timing.ratios([2.0], [0.1], [1.0])]
    return spark.createDataFrame([tuple(r[k] for k in ("full", "idle", "one_file", "ratio", "passed")) for r in out], "full double, idle double, one_file double, ratio double, passed boolean")
