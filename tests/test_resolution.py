import pytest
from pyspark.sql import functions as F

from graphloom.operators import extract_javascript as js
from graphloom.operators import extract_python as py
from graphloom.operators import facts, modules
from graphloom.operators import resolve as R

PY = {
    "pkg/__init__.py": "from .core import Base, helper\n",
    "pkg/core.py": "class Base:\n    def run(self):\n        return helper(1)\n    def stop(self): pass\ndef helper(x):\n    return x\n",
    "pkg/app.py": (
        "import os\nfrom pkg import Base, helper\nfrom . import core\nclass App(Base):\n    def go(self):\n        self.run(); self.own(); super().stop(); os.getcwd()\n        core.helper(2)\n"
        "    def own(self):\n        return list(map(helper, []))\ndef cb(helper):\n    helper()\n"
    ),
    "main.py": "from pkg.app import App\na = App()\na.go()\nonly_here()\nx.items()\n", "util.py": "def only_here(): pass\nclass Bag:\n    def items(self): pass\n", "bad.py": "def (:\n",
    "ext.py": "from lib_x import Outer\nfrom pkg.core import Base\nclass M(Outer, Base):\n    def t(self):\n        self.__enter__(); self.run()\n    \nclass Base2(Base):\n    def __enter__(self): pass\nclass N(Outer, Base2):\n    def t(self):\n        self.__enter__()\n",
    "svc/mailer.py": "class Mailer:\n    def deliver(self): pass\nclass Pigeon:\n    def deliver(self): pass\n", "use.py": "def f(mailer2):\n    pass\ndef g():\n    mailer.deliver()\n",
}
JS = {
    "web/api.ts": 'export function load(u) { return u; }\nexport default class Client { get() { return load(1); } }\n', "web/index.ts": 'export { load as fetchIt } from "./api";\nexport * from "./api";\n',
    "web/app.tsx": 'import Client, { load } from "./api";\nimport { fetchIt } from "@/index";\nimport React from "react";\nexport const App = () => { const c = new Client(); load(2); fetchIt(3); React.run(); return <Client x={load}/>; }\n',
}


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([(k, str(len(v)), v) for k, v in {**PY, **JS}.items()], "path string, content_hash string, text string")
    config = {"folder": "web", "base_url": None, "patterns": [("@/*", ["web/*"])]}
    out = R.build_edges(facts.extracted(files), files.select("path"), [config])
    return {(r.source_key, r.target_key, r.relation): (r.confidence, r.resolution_tier, r.resolution_status) for r in out["edges"].collect()}, out


def test_tiers(built):
    e = built[0]
    assert e["main.py", "pkg/app.py", "IMPORTS"] == (1.0, "path", "resolved")
    assert e["main.py", "pkg/app.py::App", "CALLS"] == (0.95, "import_map", "resolved")
    assert e["pkg/app.py::App.go", "pkg/core.py::helper", "CALLS"] == (0.95, "import_map", "resolved")
    assert e["pkg/app.py::App.go", "pkg/app.py::App.own", "CALLS"] == (0.90, "same_module", "resolved")
    assert e["pkg/app.py::App.go", "pkg/core.py::Base.run", "CALLS"] == (0.85, "inherited", "resolved")
    assert e["pkg/app.py::App.go", "pkg/core.py::Base.stop", "CALLS"][1] == "inherited"
    assert e["main.py", "util.py::only_here", "CALLS"] == (0.75, "unique_name", "candidate")
    assert e["use.py::g", "svc/mailer.py::Mailer.deliver", "CALLS"] == (0.55, "suffix", "candidate")
    assert e["pkg/app.py::App", "pkg/core.py::Base", "INHERITS"][0] == 0.95
    assert e["pkg/app.py::App.own", "pkg/core.py::helper", "REFERENCES"][0] == 0.95


def test_blocking_rules(built):
    e = built[0]
    assert not any(s == "pkg/app.py::cb" for s, _, r in e if r == "CALLS")  # a parameter shadows the import
    assert not any("getcwd" in t for _, t, _ in e)  # an external package is no symbol
    assert ("main.py", "util.py::Bag.items", "CALLS") not in e  # a name that built-ins have
    assert not any(s.startswith("bad.py") for s, _, _ in e)


def test_opaque_bases_make_special_methods_uncertain(built):
    e = built[0]
    assert e["ext.py::N.t", "ext.py::Base2.__enter__", "CALLS"] == (0.60, "inherited_uncertain", "candidate")
    assert e["ext.py::M.t", "pkg/core.py::Base.run", "CALLS"] == (0.85, "inherited", "resolved")


def test_barrels_aliases_and_jsx(built):
    e = built[0]
    assert e["web/app.tsx", "web/index.ts", "IMPORTS"] == (0.9, "path", "resolved")
    assert e["web/app.tsx::App", "web/api.ts::load", "CALLS"][1] == "import_map"
    assert e["web/app.tsx::App", "web/api.ts::Client", "CALLS"][1] == "import_map"
    assert not any("run" in t and s.startswith("web/") for s, t, _ in e)


def test_linearisation():
    out = R.linearise({"d": ["b", "c"], "b": ["a"], "c": ["a"], "a": []})
    assert [k for k, _ in out["d"]] == ["d", "b", "c", "a"]
    assert R.linearise({"x": ["a", "b"], "y": ["b", "a"], "z": ["x", "y"], "a": [], "b": []})["z"][0] == ("z", False)
    assert [k for k, _ in R.linearise({"p": ["q"], "q": ["p"]})["p"]] == ["p", "q"]
    assert dict(R.linearise({"m": [None, "k"], "k": []})["m"]) == {"m": False, "k": True}


def test_refreshed_facts_reparse_changed_files_only(spark):
    files = spark.createDataFrame([(k, str(len(v)), v) for k, v in PY.items()], "path string, content_hash string, text string")
    old = facts.extracted(files)
    new = files.withColumn("content_hash", F.when(F.col("path") == "util.py", "0").otherwise(F.col("content_hash"))).withColumn("text", F.when(F.col("path") == "util.py", "def other(): pass").otherwise(F.col("text")))
    a = {r.path: r for r in facts.refreshed(new, old).collect()}
    assert len(a) == len(PY) and [s.name for s in a["util.py"].symbols] == ["other"] and a["bad.py"].error.startswith("syntax error")


def test_python_extraction_details():
    f = py.extract("@d\ndef a(x, *, y=1):\n    import q as z\n    [i for i in x]\n    global g\n    g = 1\n    w = lambda v: v\nif True:\n    class B(L[int], metaclass=M):\n        b = 1\nA = B\n")
    assert [(s["qualname"], s["kind"], s["first"]) for s in f["symbols"]] == [("a", "Function", 1), ("B", "Class", 9)]
    names = {(x["name"], x["first"], x["last"]) for x in f["locals"]}
    assert {("x", 3, 7), ("y", 3, 7), ("w", 3, 7), ("i", 4, 4), ("v", 7, 7)} <= names and not any(n == "g" for n, _, _ in names)
    assert f["imports"] == [{"spec": "q", "level": 0, "line": 3, "local": "z", "member": None, "first": 3, "last": 7}]
    assert f["bases"] == [{"class_qualname": "B", "line": 9, "name": "L", "receiver": None}] and f["aliases"][0]["alias"] == "A"
    assert py.declaration("class A:\n    def f(self,\n          x):\n        return 1\n", 2, 4) == "    def f(self,\n          x):"


def test_javascript_extraction_details():
    f = js.extract('import * as a from "./a"; // import x from "y"\nconst s = `function no() {}`;\nclass K extends a.B { static m() { return this.n() } n = () => 1 }\nmodule.exports = K;\nconst re = /function q\\(/g;\nconst L = lazy(() => import("./lazy"));\n')
    assert [s["qualname"] for s in f["symbols"]] == ["K", "K.m", "K.n"] and f["default_export"] == "K"
    assert f["bases"] == [{"class_qualname": "K", "line": 3, "name": "B", "receiver": "a"}]
    assert {(i["spec"], i["local"], i["member"]) for i in f["imports"]} == {("./a", "a", None), ("./lazy", "L", "default")}
    assert ("n", "this") in {(c["name"], c["receiver"]) for c in f["calls"]}


def test_module_resolution_order(spark):
    files = spark.createDataFrame([(p,) for p in ("a.py", "pkg/a.py", "pkg/b/__init__.py", "src/c.py", "pkg/sub/m.py")], "path string")
    imports = spark.createDataFrame([("pkg/sub/m.py", "a", 0), ("pkg/sub/m.py", "b", 0), ("pkg/sub/m.py", "c", 0), ("pkg/sub/m.py", "a", 2), ("pkg/sub/m.py", "none", 0), ("pkg/sub/m.py", "a", 9)], "path string, spec string, level int")
    got = {(r.spec, r.level): (r.file, r.confidence) for r in modules.resolve_python(imports, files).collect()}
    assert got == {("a", 0): ("a.py", 1.0), ("b", 0): ("pkg/b/__init__.py", 0.9), ("c", 0): ("src/c.py", 0.9), ("a", 2): ("pkg/a.py", 1.0)}


def test_configs_follow_extends():
    texts = {"tsconfig.json": '{ "extends": "./base", // c\n "compilerOptions": {"baseUrl": "src",} }', "base.json": '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}'}
    (c,) = modules.read_configs(["tsconfig.json", "base.json"], texts.get)
    assert c["base_url"] == "src" and c["patterns"] == [("@/*", ["lib/*"])]


def test_containers(spark):
    got = {(r.source_key, r.target_key) for r in modules.containers(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")).collect()}
    assert got == {("a", "a/b"), ("a/b", "a/b/c.py"), ("a", "a/d.py")}
