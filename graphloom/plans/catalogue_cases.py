"""Registered queries whose inputs are spelled out: commands, JSON, paths, extraction, runs, packing and sessions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import evaluate, extract_python, facts, logs, lookup, observe, pack, reports, text, traces
from graphloom.plans.cases import by_row, cases
from graphloom.sources import repo, small, transcripts

# -- commands, JSON, paths ------------------------------------------------------

_LINES = [
    ("Bash", "pytest -q tests/{k}", "check"), ("Bash", "cd a{k} && python -m pytest", "check"), ("Bash", "pytest -q | tee log{k}", "command"), ("exec_command", "grep -rn pytest {k}", "command"), ("functions.exec_command", "npm run test", "check"),
    ("Bash", "ls {k}; npx jest", "check"), ("Bash", "pytest; ls {k}", "command"), ("Bash", "pytest > {k}.log", "command"), ("Bash", "pytest || true", "command"), ("Edit", "x{k}", "edit"), ("apply_patch", "pytest", "edit"), ("search", "how to run pytest", "tool"),
    ("Bash", "echo 'pytest; {k}'", "command"), ("Bash", "/usr/bin/pytest {k}", "check"), ("Bash", "python3 -m unittest t{k}", "check"), ("Bash", "cargo build", "command"), ("Bash", "go test ./...", "check"), ("Bash", "echo 'open {k}", "command"),
]


@cases("orders", "o_orderkey", "name string, arguments string", "kind VARCHAR", [((n, json.dumps({"command": line})), (kind,)) for n, line, kind in _LINES])
def command_kinds(df):
    """LG-7, command tokenisation: what a call does by its tool and the last command of its line."""
    return df.withColumn("kind", S.command_kinds("name", "arguments"))


@cases("orders", "o_orderkey", "output string", "code BIGINT", [
    (('{"exit_code": 3, "output": "{k}"}',), (3,)), (('{"exit_code": 3, "note": {k}}',), (None,)), (("Process exited with code 0\nOutput: {k}",), (0,)), (("Wall time {k}\nExit code: -2\n",), (-2,)), (("Output: {k}\nExit code: 1",), (None,)),
    (("it said exit code: 3, {k}",), (None,)), (("x" * 600 + "\nExit code: 1",), (None,)), (('[{"type": "text", "text": "{\\"exit_code\\": 7, \\"chunk_id\\": \\"{k}\\"}"}]',), (7,)), ((None,), (None,)),
])
def exit_codes(df):
    """Exit codes: a field of the output's JSON, or a line of its header."""
    return df.withColumn("code", S.exit_codes("output"))


@cases("part", "p_partkey", "path string", "answer VARCHAR", [((" ./a//{k}.py ",), ("a/{k}.py",)), (("a\\b{k}",), ("a/b{k}",)), (("/a/{k}",), (None,)), (("a/../{k}",), (None,)), (("C:\\{k}",), (None,)), (("././{k}",), ("{k}",)), (("a/..{k}",), ("a/..{k}",)), (("",), (None,))])
def answer_paths(df):
    """Paths of answers in their normal form."""
    return df.withColumn("answer", S.answer_path("path"))


@cases("part", "p_partkey", "text string", "value VARCHAR", [
    (('{"a": {k}, // c\n "b": [1, 2,],}',), ('{"a":{k},"b":[1,2]}',)), (('/* {k} */ {"u": "http://x/{k}", "s": "a /* b */ c"}',), ('{"s":"a /* b */ c","u":"http://x/{k}"}',)), (('["\\",}", {k},]',), ('["\\",}",{k}]',)),
])
def jsonc_values(df):
    """SRC-7: JSON with comments and trailing commas."""
    return df.withColumn("value", by_row(lambda t: S.canonical(json.loads(S.strip_jsonc(t))), ["text"], "value"))


@cases("part", "p_partkey", "text string, at string", "value VARCHAR", [
    (('{"a": [{"b": {k}}]}', "a[0].b"), ("{k}",)), (('{"a": {"c": 1, "b": "é{k}"}}', "a"), ('{"b":"é{k}","c":1}',)), (('{"a": []}', "a[0]"), (None,)), (('[[1, {k}]]', "[0][1]"), ("{k}",)), (('{"a": 1}', "a.b"), (None,)),
])
def json_fields(df):
    """Nested fields by path, as canonical JSON."""

    def field(t: str, at: str) -> str | None:
        found = S.at_path(json.loads(t), at)
        return None if found is None else S.canonical(found)

    return df.withColumn("value", by_row(field, ["text", "at"], "value"))


_SCHEMA = {"type": "object", "required": ["p"], "properties": {"p": {"type": "integer", "minimum": 0}, "q": {"enum": ["a", "b"]}, "r": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}


@cases("part", "p_partkey", "value string", "faults BIGINT, first VARCHAR", [
    (('{"p": {k}}',), (0, None)), (('{"q": "a"}',), (1, "$.p: missing")), (('{"p": "{k}"}',), (1, "$.p: not of type integer")), (('{"p": 1, "z": {k}}',), (1, "$.z: not allowed")), (('{"p": -1, "q": "c"}',), (2, "$.p: below 0")),
    (('{"p": 1, "r": ["{k}", 2]}',), (1, "$.r[1]: not of type string")), (("[{k}]",), (1, "$: not of type object")),
])
def schema_faults(df):
    """EV-4: errors of arguments against a small JSON Schema."""
    errors = by_row(lambda t: S.schema_errors(json.loads(t), _SCHEMA), ["value"], "e", "array<string>")
    return df.withColumn("e", errors).withColumn("faults", F.size("e").cast("long")).withColumn("first", F.get("e", F.lit(0)))


@cases("part", "p_partkey", "text string", "value VARCHAR", [(('x {"a": 1} y {"b": {"c": {k}}} z {',), ('{"b":{"c":{k}}}',)), (("no object {k}",), (None,)), (('{"a": "}"} tail',), ('{"a":"}"}',)), (("{broken} {}",), ("{}",))])
def last_objects(df):
    """The last balanced JSON object in prose."""
    return df.withColumn("value", by_row(lambda t: None if (v := S.last_object(t)) is None else S.canonical(v), ["text"], "value"))


@cases("part", "p_partkey", "text string, size int", "prefix VARCHAR", [(("ééé", 3), ("é",)), (("abc{k}", 2), ("ab",)), (("漢字", 6), ("漢字",)), (("😀x", 3), ("",)), ((None, 3), (None,)), (("", 0), ("",))])
def byte_prefixes(df):
    """UTF-8 prefixes of whole characters."""
    return df.withColumn("prefix", S.byte_prefix("text", F.col("size")))


@cases("part", "p_partkey", "at string, spec string", "path VARCHAR", [(("a/b", "../c{k}"), ("a/c{k}",)), (("a", "../../{k}"), (None,)), (("", "./x/./{k}"), ("x/{k}",)), (("a//b", "c"), ("a/b/c",)), (("a", ".."), ("",))])
def joined_paths(df):
    """Normal paths below the root."""
    return df.withColumn("path", by_row(S.join_path, ["at", "spec"], "path"))


@cases("part", "p_partkey", "generation string, query string, asked string", "place BIGINT, fault VARCHAR", [(("g{k}", "q", "g{k}"), (7, None)), (("g{k}", "q", "h"), (None, "stale cursor: the snapshot has changed")), (("g", "other", "g"), (None, "the cursor belongs to another query"))])
def cursors(df):
    """TK-2: a cursor is good for its own generation and query."""

    def place(generation: str, query: str, asked: str) -> dict:
        try:
            return {"place": S.cursor_offset(S.cursor(generation, query, 7), asked, "q"), "fault": None}
        except ValueError as e:
            return {"place": None, "fault": str(e)}

    return df.withColumn("c", by_row(place, ["generation", "query", "asked"], "c", "struct<place: long, fault: string>")).select("*", "c.*")


@cases("part", "p_partkey", "log string, kind string, code int", "shown VARCHAR", [
    (("a.py ..F [ 50%]\n==== FAILURES ====\nE {k}\nb.py .. [100%]", "pytest", 1), ("==== FAILURES ====\nE {k}",)), (("ok {k}", "pytest", 0), ("ok {k}",)), (("x\na.ts(1,2): error TS{k}: no\ny", "tsc", 2), ("a.ts(1,2): error TS{k}: no",)), (("any {k}\nlog", "other", 1), ("any {k}\nlog",)),
])
def reduced_logs(df):
    """EXT-17"""
    return df.withColumn("shown", by_row(text.reduced_output, ["log", "kind", "code"], "shown"))


@cases("nation", "n_nationkey", "text string", "value VARCHAR", [
    (('repo: "r{k}"\nn: {k}\ntasks:\n  - id: "a"\n    path: []\n  - id: "b"\n    ok: true\n',), ('{"n":{k},"repo":"r{k}","tasks":[{"id":"a","path":[]},{"id":"b","ok":true}]}',)), (('a:\n  b:\n    - 1\n    - "x: y"\n  c: null\n',), ('{"a":{"b":[1,"x: y"],"c":null}}',)), (("- 1.5\n- -{k}\n",), ("[1.5,-{k}]",)),
])
def yaml_values(df):
    """SRC-15: a subset of YAML."""
    return df.withColumn("value", by_row(lambda t: S.canonical(small.yaml_subset(t)), ["text"], "value"))


# -- extraction -----------------------------------------------------------------


def _facts(df, suffix: str = ".py"):
    files = df.select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(suffix)).alias("path"), F.sha2(F.col("source").cast("binary"), 256).alias("content_hash"), F.col("source").alias("text"))
    found = facts.extracted(files).withColumn("k", F.regexp_extract("path", r"m(\d+)", 1).cast("long"))
    return found


def _joined(column: str, shown):
    """The rows of an array of facts as sorted texts."""
    return F.array_join(F.array_sort(F.transform(column, shown)), ";")


_none = lambda c: F.coalesce(c, F.lit("-"))


@cases("part", "p_partkey", "source string", "found VARCHAR", [
    (("with x:\n    def a{k}(): pass\nfor i in y:\n    class B:\n        def m(self): pass\nelse:\n    def c(): pass\n",), ("Class B 4;Function a{k} 2;Function c 7;Method B.m 5",)),
    (("while x:\n    def a(): pass\nmatch x:\n    case 1:\n        def b{k}(): pass\n    case _:\n        def c(): pass\n",), ("Function a 2;Function b{k} 5;Function c 7",)),
    (("try:\n    def a(): pass\nexcept* E:\n    def b(): pass\nelse:\n    def c{k}(): pass\nfinally:\n    def d(): pass\n",), ("Function a 2;Function b 4;Function c{k} 6;Function d 8",)),
    (("async def a():\n    async with x:\n        def inner{k}(): pass\nclass C:\n    if x:\n        @p\n        def d(self): pass\n",), ("Class C 4;Function a 1;Method C.d 6",)),
])
def python_containers(df):
    """EXT-2: symbols in every statement that has a body, but in no function."""
    return _facts(df).withColumn("found", _joined("symbols", lambda s: F.concat_ws(" ", s["kind"], s["qualname"], s["first"].cast("string"))))


@cases("part", "p_partkey", "source string", "found VARCHAR", [(("class A{k}(B, c.D, metaclass=M):\n    pass\n",), ("A{k} B -;A{k} D c",)), (("class A(L[int]):\n    class I(x().y, *z): pass\n",), ("A L -;A.I y ?",)), (("class A: pass\n",), ("",))])
def python_bases(df):
    """EXT-5: bases without their arguments; keywords are none."""
    return _facts(df).withColumn("found", _joined("bases", lambda b: F.concat_ws(" ", b["class_qualname"], b["name"], _none(b["receiver"]))))


@cases("part", "p_partkey", "source string", "found VARCHAR", [(("A = B\nC = D[int]\nE = m.F{k}\nG = f()\nH = 1\n",), ("A B -;C D -;E F{k} m",)), (("try:\n    A = B\nexcept E:\n    A = C{k}\ndef f():\n    X = Y\n",), ("A B -;A C{k} -",)), (("if x:\n    A = B\nelse:\n    a, b = C\nclass K:\n    D = E\n",), ("A B -",))])
def python_aliases(df):
    """EXT-6: names of the module that stand for others."""
    return _facts(df).withColumn("found", _joined("aliases", lambda a: F.concat_ws(" ", a["alias"], a["name"], _none(a["receiver"]))))


@cases("part", "p_partkey", "source string", "found VARCHAR", [
    (("def f(a, *b, c{k}=1, **d):\n    e = 1\n    for g in a: pass\n",), ("a 2-3;b 2-3;c{k} 2-3;d 2-3;e 2-3;g 2-3",)), (("def f():\n    global x\n    x = 1\n    with y as z:\n        pass\n    if (w := 1): pass\n",), ("w 2-6;z 2-6",)), (("q = [i for i in z]\nr = lambda v{k}: v{k}\n",), ("i 1-1;v{k} 2-2",)),
])
def python_locals(df):
    """EXT-7: names that a scope binds, with its lines."""
    return _facts(df).withColumn("found", _joined("locals", lambda n: F.concat(n["name"], F.lit(" "), n["first"].cast("string"), F.lit("-"), n["last"].cast("string"))))


@cases("part", "p_partkey", "source string", "found VARCHAR", [(("class A:\n    @property\n    def x(self): return 1\n    @x.setter\n    def x(self, v):\n        pass\n",), ("A 1-6;A.x 2-3;A.x 4-6",)), (("def f{k}(): pass\ndef f{k}():\n    pass\n",), ("f{k} 1-1;f{k} 2-3",))])
def python_ranges(df):
    """EXT-16: every range of a name that is defined more than once."""
    return _facts(df).withColumn("found", _joined("symbols", lambda s: F.concat(s["qualname"], F.lit(" "), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))))


@cases("part", "p_partkey", "source string, first int, last int", "head VARCHAR", [
    (("class A:\n    def f(self,\n          x{k}):\n        return 1\n", 2, 4), ("    def f(self,\n          x{k}):",)), (("@d\ndef g{k}():\n    pass\n", 1, 3), ("@d\ndef g{k}():",)), (("def f(): return 1\n", 1, 1), ("def f():",)), (("def f(" + "a" * 1100 + "): \n    pass\n", 1, 2), (None,)), (("x = {k}\n", 1, 1), (None,)),
])
def declaration_heads(df):
    """EXT-15: a definition up to its body, if it is short."""
    return df.withColumn("head", by_row(extract_python.declaration, ["source", "first", "last"], "head"))


@cases("part", "p_partkey", "source string", "found VARCHAR", [
    (('import D, { a as b{k} } from "./m";\nimport * as n from "n";\n',), ("./m D default;./m b{k} a;n n -",)), (('const { x, y: z } = require("./r{k}");\nconst w = require("w");\n',), ("./r{k} x x;./r{k} z y;w w -",)), (('const L = lazy(() => import("./lazy{k}"));\n',), ("./lazy{k} L default",)),
])
def javascript_imports(df):
    """EXT-10: bindings of modules, required and lazy ones too."""
    return _facts(df, ".ts").withColumn("found", _joined("imports", lambda i: F.concat_ws(" ", i["spec"], i["local"], _none(i["member"]))))


@cases("part", "p_partkey", "source string", "name VARCHAR, found VARCHAR", [
    (("function F{k}() {}\nexport default F{k};\n",), ("F{k}", "")), (("const F = () => 1;\nexport default memo(F);\n",), ("F", "")), (("class K{k} {}\nmodule.exports = K{k};\n",), ("K{k}", "")), (('export { a as b } from "./m";\nexport * from "./n{k}";\n',), (None, "./m a b;./n{k} * *")),
    (('import { a } from "./m";\nexport { a as c{k} };\n',), (None, "./m a c{k}")),
])
def javascript_exports(df):
    """EXT-11: default names and re-exports."""
    f = _facts(df, ".js").withColumn("name", F.col("default_export"))
    return f.withColumn("found", _joined("reexports", lambda r: F.concat_ws(" ", r["spec"], r["imported"], r["exported"])))


@cases("part", "p_partkey", "source string", "found VARCHAR", [
    (("const a = [f{k}, g];\nrun(h.i);\n",), ("f{k} - 1;g - 1;i h 2",)), (("const a = x ? f{k} : g;\nconst b = f || g;\nif (!h) {}\n",), ("f - 2;f{k} - 1;g - 1;g - 2;h - 3;x - 1",)), (("let t: typeof f{k};\nnew K(f);\nq(1);\nfunction r(c?: T) {}\n",), ("f - 2",)),
    (("const { a = f{k} } = o;\nexport default h;\n",), ("f{k} - 1;o - 1",)),
])
def javascript_values(df):
    """EXT-13: names that are used as values: not called, constructed, declared or meant as a type."""
    return _facts(df, ".ts").withColumn("found", _joined("values", lambda v: F.concat_ws(" ", v["name"], _none(v["receiver"]), v["line"].cast("string"))))


_CONFIGS = {"tsconfig.json": '{"extends": "./b"}', "b.json": "{}"}


@cases("nation", "n_nationkey", "texts string, files string", "same BOOLEAN", [
    ((json.dumps(_CONFIGS), '[["src/a{k}.ts", "source"]]'), (True,)), ((json.dumps(_CONFIGS), '[["src/a.ts", "source"], ["docs/{k}.md", "doc"]]'), (True,)), ((json.dumps(_CONFIGS | {"b.json": '{"x": {k}}'}), '[["src/a.ts", "source"]]'), (False,)),
    ((json.dumps(_CONFIGS | {"src/jsconfig.json": "{}"}), '[["src/a.ts", "source"]]'), (False,)), ((json.dumps(_CONFIGS | {"lib/tsconfig.json": "{}"}), '[["src/{k}.ts", "test"]]'), (True,)),
])
def config_digests(df):
    """SRC-8: a digest of the configurations in and above the folders of sources and tests, with what they extend."""
    base = repo.config_digest(_CONFIGS.get, [("src/a.ts", "source")])
    same = by_row(lambda t, f: repo.config_digest(json.loads(t).get, [tuple(x) for x in json.loads(f)]) == base, ["texts", "files"], "same", "boolean")
    return df.withColumn("same", same)


@cases("part", "p_partkey", "source string, ending string", "symbols BIGINT, fault BOOLEAN", [
    (("def f{k}(): pass\n", ".py"), (1, False)), (("function f{k}() {}\nclass A { m() {} }\n", ".tsx"), (3, False)), (("def f(): pass\n", ".txt"), (0, False)), (("def (:\n", ".py"), (0, True)), (("const f = () => {k};\n", ".mjs"), (1, False)),
])
def extraction_dialects(df):
    """EXT-1: the extension chooses the reader; what does not parse has a fault and no symbols."""
    files = df.select(F.concat(F.lit("m"), F.col("k").cast("string"), "ending").alias("path"), F.lit("h").alias("content_hash"), F.col("source").alias("text"))
    return facts.extracted(files).select(F.regexp_extract("path", r"m(\d+)", 1).cast("long").alias("k"), F.size("symbols").cast("long").alias("symbols"), F.col("error").isNotNull().alias("fault"))


# -- runs -----------------------------------------------------------------------


def _call(tool: str, result=None, **a) -> dict:
    return {"tool": tool, "arguments": a, **({} if result is None else {"result": result})}


_FIND, _READ = _call("find", {"items": [{"id": 1}]}, q="x{k}"), _call("read", "t", p=1)
_CASE = {"id": "c{k}", "expected_calls": [_call("find", q="x{k}"), _call("read", p=1)], "expected_evidence": ["e1", "e{k}x"], "dependencies": [{"from_call": 0, "from_result_path": "items[0].id", "to_call": 1, "to_argument": "p"}]}
_RUN = {"calls": [_FIND, _READ], "returned_evidence": ["e1", "e{k}x"]}
_LOST = {**_call("find", q="x{k}"), "error": "Timeout {k}"}
_RULE = {"recovery": {"trigger": "timeout", "max_retries": 1}, "expected_calls": [_call("find", q="x{k}"), _call("find", q="x{k}"), _call("read", p=1)], "dependencies": []}


def _told(case: dict | None = None, **run) -> tuple[str, str]:
    return json.dumps({**_CASE, **(case or {})}), json.dumps({**_RUN, **run})


_SCORED = [
    (_told(), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 1, None, None, "passed")),
    (_told(returned_evidence=["e1", "e{k}x", "z"]), (2, 1.0, 1.0, True, 1.0, 1.0, 0.6667, 1.0, 0, 0, 0, 1, None, None, "passed")),
    (_told(returned_evidence=["e1"]), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 0.5, 0, 0, 0, 1, None, None, "failed")),
    (_told(calls=[_FIND]), (1, 1.0, 0.5, False, 1.0, 0.5, 1.0, 1.0, 0, 0, 0, 0, None, None, "failed")),
    (_told(calls=[_FIND, _call("read", "t", p=2)]), (2, 1.0, 1.0, True, 0.5, 0.5, 1.0, 1.0, 0, 0, 0, 0, None, None, "failed")),
    (_told(calls=[_FIND, _call("read", p=1)]), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 1, None, None, "not_evaluated")),
    (_told({"forbidden_tools": ["read"]}), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 1, 0, 1, None, None, "failed")),
    (_told({"scope_paths": ["src"]}, calls=[_call("find", {"items": [{"id": 1}]}, q="x{k}", file="lib/{k}.py"), _READ]), (2, 1.0, 1.0, True, 0.6667, 1.0, 1.0, 1.0, 0, 0, 1, 1, None, None, "failed")),
    (_told(_RULE, calls=[_LOST, _FIND, _READ]), (3, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 1, 0, 0, 0, True, 1, "passed")),
    (_told(_RULE, calls=[_LOST, _LOST, _FIND, _READ]), (3, 0.75, 1.0, False, 0.75, 1.0, 1.0, 1.0, 2, 0, 0, 0, True, 2, "failed")),
    (_told(_RULE, calls=[_LOST, _READ]), (2, 1.0, 0.6667, False, 1.0, 0.6667, 1.0, 1.0, 1, 0, 0, 0, False, 0, "failed")),
    (_told({"should_abstain": True, "dependencies": []}, calls=[]), (0, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 0, None, None, "passed")),
    (_told({"requires_confirmation": True}), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 1, None, None, "failed")),
    (_told({"expected_latest_arguments": [{"call_index": 0, "argument": "q", "value": "y"}]}), (2, 1.0, 1.0, True, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 1, None, None, "failed")),
]


@cases("customer", "c_custkey", "case string, run string", "matched BIGINT, trajectory_precision DOUBLE, trajectory_recall DOUBLE, exact BOOLEAN, argument_precision DOUBLE, argument_recall DOUBLE, evidence_precision DOUBLE, evidence_recall DOUBLE, n_errors BIGINT, n_unsafe BIGINT, n_out_of_scope BIGINT, n_dependencies_met BIGINT, recovered BOOLEAN, retries BIGINT, status VARCHAR", _SCORED)
def runs_scored(df):
    """EV-2 to EV-4, EV-6 to EV-11: alignment, arguments, evidence, trajectory, safety, dependencies, recovery, status."""
    key = F.concat(F.lit("c"), F.col("k").cast("string"))
    out = traces.evaluate_runs(df.select(key.alias("case_id"), "case"), df.select(key.alias("case_id"), "run"))
    return out.withColumn("k", F.expr("substring(case_id, 2)").cast("long"))


@cases("customer", "c_custkey", "case string, run string", "n_ungrounded BIGINT", [(_told({"messages": ["find x{k} now, p 1"]}), (0,)), (_told({"messages": ["find x{k}y"]}), (1,)), (_told({"messages": [{"content": "x{k}", "turn": 2}]}), (1,)), (_told({"messages": []}, messages=["(x{k})"]), (0,))])
def runs_grounded(df):
    """EV-5: texts of arguments that are whole words of what was visible."""
    key = F.concat(F.lit("c"), F.col("k").cast("string"))
    out = traces.evaluate_runs(df.select(key.alias("case_id"), "case"), df.select(key.alias("case_id"), "run"))
    return out.withColumn("k", F.expr("substring(case_id, 2)").cast("long"))


@cases("customer", "c_custkey", "case string, run string", "n BIGINT, fault VARCHAR", [
    (_told(), (0, None)), (("{", json.dumps(_RUN)), (1, "no JSON of finite values")), (_told({"clarification_required": True}), (1, "clarification needs abstention")), (_told({"dependencies": [{"from_call": 1, "to_call": 1}]}), (1, "a dependency on a later call")),
    (_told({"expected_calls": [{**_call("find", query=3), "semantic_arguments": ["query"]}]}), (1, "semantic arguments that are no free text")), ((json.dumps(_CASE), '{"calls": [{}]}'), (1, "calls without tools")),
])
def runs_faulty(df):
    """EV-1: cases and runs that can't be scored."""
    key = F.col("k").cast("string")
    found = traces.faults(df.select(key.alias("case_id"), "case"), df.select(key.alias("case_id"), "run")).groupBy("id").agg(F.count("*").alias("n"), F.min("fault").alias("fault"))
    return df.join(found, key == F.col("id"), "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), "fault")


@cases("customer", "c_custkey", "run string", "blocked BIGINT, faults BIGINT, found VARCHAR", [((json.dumps({"calls": [_call("find", q="x{k}"), _call("rm")]}),), (1, 0, "x{k}")), ((json.dumps({"calls": [_call("find", q=3), _call("find", q="x", file="../{k}")]}),), (2, 0, None)), ((json.dumps({"calls": [_call("bad"), _call("find", q="{k}")]}),), (0, 1, "{k}"))])
def runs_replayed(df):
    """EV-14: calls made again by read-only tools, others blocked."""

    def bad(args):
        raise KeyError("k")

    def again(t: str) -> dict:
        out = traces.replay(json.loads(t), {"find": lambda a: a["q"], "bad": bad}, {"find": {"type": "object", "properties": {"q": {"type": "string"}}}}, ["."])
        found = [c["result"] for c in out["calls"] if "result" in c]
        return {"blocked": out["blocked_calls"], "faults": sum("error" in c and "blocked" not in c for c in out["calls"]), "found": found[0] if found else None}

    return df.withColumn("r", by_row(again, ["run"], "r", "struct<blocked: long, faults: long, found: string>")).select("*", "r.*")


@cases("part", "p_partkey", "expected array<string>, actual array<string>", "missing BIGINT, extra BIGINT, correct BOOLEAN", [((["a", "b"], ["b", "a", "a"]), (0, 0, True)), ((["a", "b"], ["a", "c"]), (1, 1, False)), (([], ["x"]), (0, 1, False)), ((["a"], []), (1, 0, False))])
def answers_graded(df):
    """EV-20: answers as sets."""
    return evaluate.grade(df).withColumn("missing", F.col("missing").cast("long")).withColumn("extra", F.col("extra").cast("long"))


@cases("part", "p_partkey", "measured double, crashed boolean, bytes long", "admission VARCHAR, again BOOLEAN", [((0.96, True, 0), ("PASS", True)), ((0.94, True, 5), ("FAIL", False)), ((None, False, 0), ("UNKNOWN", False)), ((0.95, False, 9), ("PASS", False))])
def gates(df):
    """EV-24, EV-25: what is not measured never passes; only a crash before any output is tried again."""
    return df.withColumn("admission", evaluate.admission(F.col("measured"), 0.95)).withColumn("again", evaluate.retryable(F.col("crashed"), F.col("bytes")))


# -- packing and lookup -----------------------------------------------------------


@cases("part", "p_partkey", "tokens int, most int", "bytes BIGINT, fault VARCHAR", [((100, None), (400, None)), ((None, 50), (50, None)), ((32000, 1000), (1000, None)), ((0, None), (None, "budget_tokens must be 1 to 32000")), ((1, 70000), (None, "max_bytes must be 1 to 65536"))])
def budgets(df):
    """PK-3, FLT-14: four bytes a token within the bound; bad arguments are errors."""

    def size(tokens, most) -> dict:
        try:
            return {"bytes": pack.budget_bytes(None if tokens is None or tokens != tokens else int(tokens), None if most is None or most != most else int(most)), "fault": None}
        except ValueError as e:
            return {"bytes": None, "fault": str(e)}

    return df.withColumn("b", by_row(size, ["tokens", "most"], "b", "struct<bytes: long, fault: string>")).select("*", "b.*")


@cases("part", "p_partkey", "payload string", "size BIGINT", [(('{"a":1}',), (1024 + len(r'{"structured":{"a":1},"text":"{\n  \"a\": 1\n}"}'),)), (("[]",), (1024 + len('{"structured":[],"text":"[]"}'),))])
def encoded_sizes(df):
    """PK-1: bytes of a message with its readable text."""
    return df.withColumn("size", by_row(lambda t: pack.encoded_size(json.loads(t)), ["payload"], "size", "long"))


_ITEMS = [{"path": "a{k}", "name": "n", "text": "t" * 4000, "outline": "o" * 300}, {"path": "b", "name": "m", "text": "u" * 9000}, {"path": "c", "name": "k"}]


@cases("part", "p_partkey", "items string, budget int", "paths VARCHAR, texts BIGINT, next BIGINT, truncated BOOLEAN, files VARCHAR", [
    ((json.dumps(_ITEMS), 65536), ("a{k},b,c", 2, None, False, "a{k},b")), ((json.dumps(_ITEMS), 14000), ("a{k},b,c", 1, None, False, "a{k},b")), ((json.dumps(_ITEMS[:1]), 2200), ("a{k}", 0, None, False, "a{k}")), ((json.dumps(_ITEMS), 1030), ("", 0, 0, True, "")),
])
def packets(df):
    """PK-2, PK-4: items in order, texts shed first, with the hashes of the files they cite."""

    def packed(items: str, budget: int) -> dict:
        rows = json.loads(items)
        out = pack.pack(rows, {r["path"]: "h" for r in rows if r["path"] != "c"}, int(budget))
        return {"paths": ",".join(i["path"] for i in out["items"]), "texts": sum("text" in i for i in out["items"]), "next": out["next"], "truncated": out["truncated"], "files": ",".join(sorted(out["files"]))}

    return df.withColumn("p", by_row(packed, ["items", "budget"], "p", "struct<paths: string, texts: long, next: long, truncated: boolean, files: string>")).select("k", "p.*")


@cases("part", "p_partkey", "scope string", "items BIGINT, claims BOOLEAN", [(("callers of f{k}",), (0, True)), (("dependents of {k}",), (0, True))])
def empty_answers(df):
    """GR-16: an empty answer says what it covers, and that it shows nothing more."""

    def told(scope: str) -> dict:
        e = pack.empty(scope)
        return {"items": len(e["items"]), "claims": e["scope"] == scope and "does not show" in e["claim"]}

    return df.withColumn("e", by_row(told, ["scope"], "e", "struct<items: long, claims: boolean>")).select("k", "e.*")


@cases("part", "p_partkey", "operation string, arguments string", "same BOOLEAN", [(("f", '{"a": 1, "b": {k}}'), (True,)), (("g", '{"a": 1, "b": {k}}'), (False,)), (("f", '{"a": 2, "b": {k}}'), (False,))])
def query_keys(df):
    """SNK-6, TK-2: keys of queries do not depend on the order of their arguments."""
    return df.withColumn("same", by_row(lambda o, a: lookup.query_key(o, json.loads(a)) == lookup.query_key("f", {"b": json.loads(a)["b"], "a": 1}), ["operation", "arguments"], "same", "boolean"))


# -- sessions -------------------------------------------------------------------

_A = lambda n: json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": 1, "output_tokens": 2, "total_tokens": n + 2}}}})


@cases("orders", "o_orderkey", "value string", "kind VARCHAR, command VARCHAR, passed BOOLEAN, total BIGINT", [
    ((_A(7),), ("usage", None, None, 9)), ((json.dumps({"type": "response_item", "payload": {"type": "function_call", "call_id": "c{k}", "name": "exec_command", "arguments": '{"cmd": "pytest {k}"}'}}),), ("call", "check", None, None)),
    ((json.dumps({"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c{k}", "output": "Process exited with code 1\nOutput: {k}"}}),), ("result", None, False, None)), (("{broken {k}",), ("malformed", None, None, None)),
    ((json.dumps({"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": '{"exit_code": 0, "output": "{k}"}'}}),), ("result", None, True, None)), ((json.dumps({"type": "other", "payload": {"type": "x"}}),), ("other", None, None, None)),
])
def transcript_events(df):
    """SRC-11, LG-1: lines of a transcript as typed events; malformed ones are counted, not lost."""
    rows = transcripts.events(df.select(F.lit("f").alias("file"), F.col("k").alias("seq"), "value"), "a")
    return rows.select(F.col("seq").alias("k"), "kind", "command", F.col("ok").alias("passed"), F.col("total_tokens").alias("total"))


_USE = {"input_tokens": 5, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 0, "output_tokens": 4}
_DONE = {"type": "result", "subtype": "success", "is_error": False, "result": "{k}", "usage": _USE, "total_cost_usd": 0.5}
_SAID = {"type": "assistant", "uuid": "u", "message": {"content": [{"type": "tool_use", "name": "Read", "input": {}}]}}
_text = lambda *events: "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events)


@cases("nation", "n_nationkey", "value string", "status VARCHAR, tokens BIGINT, cost_usd DOUBLE, n_tool_calls BIGINT, events BIGINT, malformed_lines BIGINT", [
    ((_text(_SAID, _SAID, _DONE),), ("ok", 10, 0.5, 1, 2, 0)), ((_text(_DONE, {**_DONE, "result": "other"}),), ("conflicting_results", None, None, 0, 2, 0)), ((_text("{bad", "", "[1]"),), ("malformed", None, None, 0, 0, 2)), ((_text(_SAID, "x"),), ("no_result", None, None, 1, 1, 1)),
    ((_text({**_DONE, "usage": {"input_tokens": 5}}),), ("usage_missing", None, 0.5, 0, 1, 0)), ((_text({**_DONE, "subtype": "error_max_budget"}),), ("budget_exhausted", 10, 0.5, 0, 1, 0)), ((_text({**_DONE, "is_error": True}, {**_DONE, "is_error": True}),), ("error_result", 10, 0.5, 0, 2, 0)),
])
def transcripts_measured(df):
    """LG-18: strict measures: usage of the final result only, and none where results differ."""
    lines = df.select(F.col("k").alias("file"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    return observe.measured(lines).withColumnRenamed("file", "k").withColumn("n_tool_calls", F.col("n_tool_calls").cast("long"))


@cases("part", "p_partkey", "client string, input_tokens long, cached_input_tokens long", "uncached BIGINT", [(("a", 10, 4), (6,)), (("b", 10, 4), (10,)), (("a", None, 4), (None,))])
def tokens_uncached(df):
    """LG-12: cached input is within the input of one client and beside that of the other."""
    return logs.token_components(df).withColumnRenamed("uncached_input_tokens", "uncached")


@cases("part", "p_partkey", "total_tokens long, unchecked_edits boolean, n_failed long, n_passed long", "advice VARCHAR", [((5, False, 0, 1), ("",)), ((None, True, 2, 1), ("record usage|run the checks after the last edit|most calls failed",)), ((5, None, None, None), ("",)), ((5, True, 1, 1), ("run the checks after the last edit",))])
def attention_rules(df):
    """LG-15: ordered suggestions."""
    return logs.attention(df).withColumn("advice", F.array_join("attention", "|"))


@cases("part", "p_partkey", "total_tokens long, n_resets long", "comparable BOOLEAN, reasons VARCHAR", [((5, 0), (True, "")), ((None, 0), (False, "no usage")), ((5, 2), (False, "counter fell")), ((None, 1), (False, "no usage|counter fell"))])
def sessions_classified(df):
    """LG-9: comparable, or excluded with every reason."""
    out = reports.classified(df, {"no usage": F.col("total_tokens").isNull(), "counter fell": F.col("n_resets") > 0})
    return out.withColumn("reasons", F.array_join("excluded_because", "|"))
