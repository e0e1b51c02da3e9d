import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import evaluate, graph, logs, lookup, pack, text, traces, vector
from graphloom.operators import edges as E

EDGE = "source_key string, target_key string, relation string, confidence double, resolution_tier string, resolution_status string"


def make(spark, rows):
    return E.deduplicated(spark.createDataFrame([(s, t, r, float(c)) for s, t, r, c in rows], "source_key string, target_key string, relation string, confidence double"))


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_key string")


def test_chain_confidences_cycles_and_depth(spark):
    e = make(spark, [("a", "b", "CALLS", 0.9), ("b", "c", "CALLS", 0.9), ("c", "d", "CALLS", 0.9), ("p", "q", "CALLS", 0.9), ("q", "p", "CALLS", 0.9)])
    got = {r.node_key: (r.distance, round(r.confidence, 4)) for r in graph.reach(e, keys(spark, "d"), 3).collect()}
    assert got == {"c": (1, 0.9), "b": (2, 0.81), "a": (3, 0.729)}
    assert [r.node_key for r in graph.reach(e, keys(spark, "p"), 5).collect()] == ["q"]
    assert [r.node_key for r in graph.reach(e, keys(spark, "d"), 0).collect()] == ["c"]


def test_dedup_tiers(spark):
    e = make(spark, [("a", "b", "CALLS", 0.75), ("a", "b", "CALLS", 0.95), ("a", "c", "IMPORTS", 1.0), ("a", "d", "CALLS", 0.55)])
    got = {r.target_key: (r.resolution_tier, r.resolution_status) for r in e.collect()}
    assert got == {"b": ("import_map", "resolved"), "c": ("path", "resolved"), "d": ("suffix", "candidate")}
    assert graph.reach(e, keys(spark, "d"), 1).isEmpty() and not graph.reach(e, keys(spark, "d"), 1, candidates=True).isEmpty()


def test_confident_detour_wins_and_no_path_is_an_answer(spark):
    e = make(spark, [("s", "t", "CALLS", 0.55), ("s", "m", "CALLS", 0.95), ("m", "t", "CALLS", 0.95)])
    r = graph.trace(e, keys(spark, "s"), keys(spark, "t"), candidates=True).first()
    assert r.path == "s > t" and r.hops == 1  # 1 / 0.55 < 2 / 0.95
    e = make(spark, [("s", "t", "CALLS", 0.35), ("s", "m", "CALLS", 0.95), ("m", "t", "CALLS", 0.95)])
    assert graph.trace(e, keys(spark, "s"), keys(spark, "t"), candidates=True).first().path == "s > m > t"
    assert graph.trace(e, keys(spark, "t"), keys(spark, "s")).first().reason == "no path"
    assert graph.trace(e, keys(spark, "s"), keys(spark, "s")).first()[:3] == ("s", 0, 0.0)


def test_all_cheapest(spark):
    e = make(spark, [("s", "a", "CALLS", 0.9), ("s", "b", "CALLS", 0.9), ("a", "t", "CALLS", 0.9), ("b", "t", "CALLS", 0.9), ("s", "c", "CALLS", 0.85), ("c", "t", "CALLS", 0.9)])
    assert {r.path for r in graph.all_cheapest(e, "s", "t").collect()} == {"s > a > t", "s > b > t"}


def test_impact_walks_through_other_scopes(spark):
    e = make(spark, [("t1", "u", "CALLS", 0.9), ("u", "core", "CALLS", 0.9)])
    n = spark.createDataFrame([("t1", "test"), ("u", "source"), ("core", "source")], "node_key string, kind string")
    (r,) = graph.impact(e, keys(spark, "core"), n, 3, scopes=("test",)).collect()
    assert (r.node_key, r.evidence, r.hop_relations) == ("t1", "core > u > t1", "CALLS,CALLS")


def test_difference_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "w")], "k int, v string")
    assert {tuple(r) for r in E.difference(a, b, ["k"], ["v"]).collect()} == {(1, "changed"), (3, "removed"), (4, "added")}
    assert {tuple(r) for r in E.upserted(a, b, ["k"]).collect()} == {(1, None), (2, None), (3, "z"), (4, "w")}


SYMS = [("f::A.run", "run", "f::A.run", "Method", "f", 1, 2), ("g::run", "run", "g::run", "Function", "g", 3, 4), ("g::Runner", "Runner", "g::Runner", "Class", "g", 5, 9)]


def test_lookup(spark):
    s = spark.createDataFrame(SYMS, "node_key string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int")
    files = spark.createDataFrame([("f", "source", "h1"), ("g", "test", "h2"), ("run", "doc", "h3")], "path string, kind string, content_hash string")
    names = lambda df: sorted(r.node_key for r in df.collect())
    assert names(lookup.find_symbol(s, "run")) == ["f::A.run", "g::run"] and names(lookup.find_symbol(s, "RUN")) == ["f::A.run", "g::Runner", "g::run"]
    assert names(lookup.find_symbol(s, "x::run")) == [] and names(lookup.resolve_targets(s, files, "run")) == ["run"] and names(lookup.resolve_targets(s, files, "run", "g")) == ["g::run"]
    assert names(lookup.in_scope(s, files, "test")) == ["g::Runner", "g::run"] and lookup.brief(s).columns[1] == "symbol_id"
    assert [r.path for r in lookup.find_files(files, None, "R").collect()] == [] and [r.path for r in lookup.find_files(files, None, "R", True).collect()] == ["run"]
    with pytest.raises(ValueError):
        lookup.bounded(s, 2)
    order = [F.col("node_key")]
    one = lookup.execute(lookup.brief(s).withColumn("node_key", F.col("symbol_id")), order, files, "g1", "list", {}, limit=2)
    assert len(one.items) == 2 and one.next_cursor and one.files == {"f": "h1", "g": "h2"}
    two = lookup.execute(lookup.brief(s).withColumn("node_key", F.col("symbol_id")), order, files, "g1", "list", {}, limit=2, at=one.next_cursor)
    assert len(two.items) == 1 and not two.truncated
    for bad in (("g2", "list", {}), ("g1", "other", {})):
        with pytest.raises(ValueError):
            lookup.execute(s, order, files, *bad, at=one.next_cursor)
    small = lookup.execute(lookup.brief(s).withColumn("node_key", F.col("symbol_id")), order, files, "g1", "list", {}, max_bytes=200)
    assert small.truncated and small.limit_reason == "bytes"


def test_health(spark):
    a = spark.createDataFrame([("a", "1", "source"), ("b", "1", "source")], "path string, content_hash string, kind string")
    b = spark.createDataFrame([("a", "2", "source"), ("c", "1", "source")], "path string, content_hash string, kind string")
    assert lookup.health(None, a)["state"] == "not_indexed" and lookup.health(a, a)["state"] == "ready" and lookup.health(a, a, (1,), (2,))["state"] == "invalid"
    assert lookup.health(a, b) == {"state": "stale", "added": ["c"], "removed": ["b"], "changed": ["a"], "n_changes": 3}
    assert lookup.health(a, b, most=0)["added"] == [] and lookup.health(a, b, most=0)["n_changes"] == 3


def chunk_truth(body, scope):
    out, start, n, size = [], 1, 0, 0
    for i, line in enumerate(body.splitlines(keepends=True), 1):
        b = len(line.encode())
        if n and (n >= 32 or size + b > 4096 or (scope == "doc" and line.startswith("#"))):
            out.append((start, i - 1))
            start, n, size = i, 0, 0
        n, size = n + 1, size + b
    return out + ([(start, start + n - 1)] if n else [])


def test_chunks(spark):
    bodies = {"a": "# H\n" + "x\n" * 70 + "## J\ny", "b": "é" * 5000 + "\nz\n", "c": "", "d": "# not\n" * 3}
    docs = spark.createDataFrame([(p, "source" if p == "d" else "doc", t) for p, t in bodies.items()], "path string, scope string, text string")
    rows = text.chunks(docs).collect()
    for p, t in bodies.items():
        mine = sorted((r.start_line, r.end_line) for r in rows if r.path == p)
        assert mine == chunk_truth(t, "source" if p == "d" else "doc")
        assert "".join(r.body for r in sorted((r for r in rows if r.path == p), key=lambda r: r.start_line)) == t
    assert {r.heading for r in rows if r.path == "a"} == {"# H", "## J"}


def test_bm25_by_hand(spark):
    import math

    docs = {1: "red blue red", 2: "blue", 3: "green green", 4: "redGreen"}
    u = spark.createDataFrame(list(docs.items()), "id int, t string").select("id", S.words("t").alias("ws"))
    q = text.query_terms(spark.createDataFrame([("Red green",)], "text string"))
    got = {r.id: r.score for r in text.bm25(u, ["id"], "ws", q).collect()}
    avg = 8 / 4
    idf = lambda n: max(1e-6, math.log((4 - n + 0.5) / (n + 0.5)))
    part = lambda tf, dl, n: idf(n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: part(2, 3, 2), 3: part(2, 2, 2), 4: part(1, 2, 2) * 2})


def test_exact_tier_and_merge(spark):
    s = spark.createDataFrame(SYMS, "node_key string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int")
    c = spark.createDataFrame([("doc.md", 1, 9)], "path string, start_line int, end_line int")
    items, missing = text.exact_tier(s, c, spark.createDataFrame([("g::run",), ("doc.md",), ("nope",)], "target string"))
    assert sorted(r.node_key for r in items.collect()) == ["doc.md", "g::run"] and [r.target for r in missing.collect()] == ["nope"]
    lex = spark.createDataFrame([("g", 3, 4, 1), ("g", 3, 8, 2)], "path string, start_line int, end_line int, position int")
    assert [(r.start_line, r.end_line, r.reason) for r in text.merged(items.where("node_key = 'g::run'"), lex).collect()] == [(3, 4, "exact"), (3, 8, "lexical")]


def test_read_and_reduce(spark):
    t = spark.createDataFrame([("p", "h", "a\r\nb\nc")], "path string, content_hash string, text string")
    assert text.read_range(t, "p", 1, 2, "h").first().text == "a\r\nb\n" and text.read_range(t, "p", 1, 2, "other").isEmpty()
    log = "t.py .. [ 50%]\n=== FAILURES ===\nE  boom\nx [100%]\n1 failed"
    assert text.reduced_output(log, "pytest", 1) == "=== FAILURES ===\nE  boom\n1 failed" and text.reduced_output(log, "pytest", 0) == log
    assert text.reduced_output("ok\na.ts(1): error TS1: x\n", "tsc", 2) == "a.ts(1): error TS1: x" and text.reduced_output("z", "other", 1) == "z"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [-3.0, -4.0])], "id int, e array<float>")
    got = [(r.id, round(r.score, 6)) for r in vector.cosine_top(v, "id", "e", v.where("id = 1"), 2).collect()]
    assert got == [(1, 1.0), (2, 0.96), (3, -1.0)]
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="vector of another size"):
            vector.normalised(spark.createDataFrame([(bad,)], "e array<float>"), "e", 2).collect()
    lists = {n: spark.createDataFrame(r, "k string, score double") for n, r in (("a", [("x", 2.0), ("y", 1.0)]), ("b", [("y", 9.0), ("z", 1.0)]))}
    assert [(r.k, r.reason) for r in vector.fused(lists, "k").collect()] == [("y", "a+b"), ("x", "a"), ("z", "b")]


def test_usage_rules(spark):
    e = spark.createDataFrame([("s", 1, "a", 10), ("s", 2, "a", 30), ("s", 3, "a", 20), ("s", 4, "b", None)], "s string, q int, m string, t long")
    assert logs.cumulative_last(e, "s", "q", ["t"]).first()[1:] == (None, 1) and logs.deduplicated_sum(e, "s", "m", ["t"]).first()[1:] == (30, 1, 2)
    with pytest.raises(ValueError):
        logs.distinct_sessions(spark.createDataFrame([("s",), ("s",)], "session string"))
    r = spark.createDataFrame([("s", "k1"), ("t", "k2"), ("u", "k3")], "session string, snapshot_key string")
    lab = spark.createDataFrame([("s", "k1", "good"), ("t", "old", "bad")], "session string, snapshot_key string, label string")
    assert {(x.session, x.label, x.label_state) for x in logs.labelled(r, lab).collect()} == {("s", "good", "current"), ("t", None, "stale"), ("u", None, "none")}


def call(tool, **a):
    return {"tool": tool, "arguments": a}


def best_alignment(gold, calls):
    """Brute force over all order-keeping pairings of equal tools."""
    import itertools

    best = (0, 0)
    for k in range(min(len(gold), len(calls)) + 1):
        for i in itertools.combinations(range(len(gold)), k):
            for j in itertools.combinations(range(len(calls)), k):
                if all(gold[x]["tool"] == calls[y]["tool"] for x, y in zip(i, j, strict=True)):
                    best = max(best, (k, sum(gold[x]["arguments"] == calls[y]["arguments"] for x, y in zip(i, j, strict=True))))
    return best


def test_alignment_equals_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(150):
        gold, calls = ([call(rng.choice("abc"), x=rng.randrange(2)) for _ in range(rng.randrange(6))] for _ in range(2))
        worth, pairs = traces.align(gold, calls)
        assert worth == best_alignment(gold, calls) and len(pairs) == worth[0]
        assert pairs == sorted(pairs) and all(gold[i]["tool"] == calls[j]["tool"] for i, j in pairs)
    assert traces.align([call("a", x=1)], [call("a", x=2), call("a", x=1)])[1] == [(0, 1)]
    # of equal ones the earliest
    assert traces.align([call("a"), call("a")], [call("a")])[1] == [(0, 0)] and traces.align([call("a")], [call("a"), call("a")])[1] == [(0, 0)]


CASE = {"id": "c", "expected_calls": [call("find", q="x"), call("read", p=1)], "expected_evidence": ["e1", "e2"], "forbidden_tools": ["rm"], "dependencies": [{"from_call": 0, "from_result_path": "items[0].id", "to_call": 1, "to_argument": "p"}]}
GOOD = {"calls": [{**call("find", q="x"), "result": {"items": [{"id": 1}]}}, {**call("read", p=1), "result": "t"}], "returned_evidence": ["e1", "e2"]}


def scored(case=None, schemas=None, **run):
    return traces.Scored({**CASE, **(case or {})}, {**GOOD, **run}, schemas or {}).row()


def test_runs():
    a, b = GOOD["calls"]
    assert scored()["status"] == "passed" and scored()["exact"] and scored()["argument_f1"] == 1.0
    assert scored(returned_evidence=["e1", "e2", "e3"])["evidence_precision"] == 0.6667
    assert scored(returned_evidence=["e1"])["status"] == "failed"
    assert scored(calls=[call("rm")])["n_unsafe"] == 1
    assert scored(calls=[a, call("read", p=1)])["status"] == "not_evaluated"
    # a dependency whose call is missing is not met, and extra calls are not an exact trajectory
    r = scored(calls=[a])
    assert (r["n_dependencies"], r["n_dependencies_met"], r["status"]) == (1, 0, "failed")
    assert scored(calls=[a, b, b])["status"] == "failed" and scored(calls=[a, b, b])["redundant"] == 1
    assert scored(calls=[a, {**call("read", p=2), "result": "t"}])["argument_recall"] == 0.5
    # scope, confirmation, carried values
    assert scored({"scope_paths": ["src"]}, calls=[{**call("find", q="x", file="src/../lib/a.py"), "result": {"items": [{"id": 1}]}}, b])["n_out_of_scope"] == 1
    assert scored({"requires_confirmation": True})["status"] == "failed" and scored({"requires_confirmation": True}, confirmed=True)["status"] == "passed"
    carry = {"expected_latest_arguments": [{"call_index": 1, "argument": "p", "value": 1}, {"call_index": 5, "argument": "p", "value": 1}]}
    assert (scored(carry)["n_carried"], scored(carry)["n_carried_met"], scored(carry)["status"]) == (2, 1, "failed")
    # final states
    assert [scored({"expected_state": {"a": 1}}, **s)["status"] for s in ({"final_state": {"a": 1}}, {"final_state": 2}, {})] == ["passed", "failed", "not_evaluated"]


def test_argument_schemas_and_grounding():
    schemas = {"find": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer", "default": 5}}}, "read": {"type": "object", "properties": {"p": {"type": "integer"}}, "required": ["p"]}}
    a, b = GOOD["calls"]
    stated = {**call("find", q="x", n=5), "result": a["result"]}
    assert scored(schemas=schemas, calls=[stated, b])["status"] == "passed" and scored(calls=[stated, b])["status"] == "failed"
    assert scored(schemas=schemas, calls=[{**a, "arguments": {"q": 3}}, {**call("write"), "result": 1}])["n_schema_errors"] == 2
    assert scored(schemas=schemas, calls=[a, {**b, "arguments": {"p": 1, "z": 1}}])["n_schema_errors"] == 1
    assert scored({"messages": ["find x now"]})["n_ungrounded"] == 0 and scored({"messages": ["find xy"]})["n_ungrounded"] == 1
    assert scored({"messages": [{"content": "x", "turn": 2}]})["n_ungrounded"] == 1
    free = {"expected_calls": [{**call("find", query="The  Words"), "semantic_arguments": ["query"]}], "dependencies": []}
    one = scored(free, calls=[{**call("find", query="the words"), "result": 1}])
    assert one["status"] == "passed" and one["argument_recall"] == 0.0


def test_recovery_and_abstention():
    a, b = GOOD["calls"]
    broken = {**call("find", q="x"), "error": "Timeout while reading"}
    rule = {"recovery": {"trigger": "timeout", "max_retries": 1}, "expected_calls": [call("find", q="x"), call("find", q="x"), call("read", p=1)], "dependencies": []}
    r = scored(rule, calls=[broken, a, b])
    assert (r["recovered"], r["retries"], r["retries_in_limit"], r["outcome"], r["status"]) == (True, 1, True, True, "passed")
    r = scored(rule, calls=[broken, broken, a, b])
    assert r["retries"] == 2 and not r["retries_in_limit"] and r["status"] == "failed"
    assert scored(rule, calls=[broken, b])["recovered"] is False
    assert scored(rule, calls=[broken, call("find", q="x"), b])["recovered"] is None and scored(rule, calls=[a, a, b])["status"] == "not_evaluated"
    assert scored(rule, calls=[broken, a, {**b, "error": "other"}])["recovered"] is False
    quiet = {"should_abstain": True, "clarification_required": True, "dependencies": [], "expected_evidence": []}
    assert scored(quiet, calls=[], returned_evidence=[], clarification="which?")["status"] == "passed" and scored(quiet, calls=[], returned_evidence=[])["status"] == "failed"


def test_runs_as_rows_and_their_faults(spark):
    import json

    cases = spark.createDataFrame([("c", json.dumps(CASE)), ("d", "{"), ("e", json.dumps({"id": "e", "clarification_required": True, "dependencies": [{"from_call": 1, "to_call": 1}]}))], "case_id string, case string")
    runs = spark.createDataFrame([("c", json.dumps({**GOOD, "run_id": "1"})), ("c", json.dumps({**GOOD, "run_id": "2", "calls": []})), ("z", json.dumps(GOOD))], "case_id string, run string")
    got = {r.run: r for r in traces.evaluate_runs(cases.where("case_id = 'c'"), runs).collect()}
    assert got["1"].status == "passed" and got["2"].status == "failed" and got["1"].recovered is None and got["1"].n_calls == 2
    found = {tuple(r) for r in traces.faults(cases, runs).collect()}
    assert found == {("d", "no JSON of finite values"), ("e", "clarification needs abstention"), ("e", "a dependency on a later call"), ("z", "an unknown case")}


def test_replay():
    run = {"calls": [call("find", q="x"), call("rm"), call("find", q=3), call("find", q="x", file="../y"), call("bad")]}
    schemas = {"find": {"type": "object", "properties": {"q": {"type": "string"}}}}

    def bad(args):
        raise KeyError("k")

    out = traces.replay(run, {"find": lambda a: {"hit": a["q"]}, "bad": bad}, schemas, ["."])
    assert out["calls"][0]["result"] == {"hit": "x"} and out["blocked_calls"] == 3 and "KeyError" in out["calls"][4]["error"]


def test_mapping_and_accounting(spark):
    theirs = spark.createDataFrame([(1, "f", "A.x"), (2, "f", "B.y"), (3, "f", "C.z")], "id int, file string, qualname string")
    ours = spark.createDataFrame([(10, "f", "A.x"), (11, "f", "Q.y"), (12, "f", "Q.z"), (13, "f", "R.z")], "id int, file string, qualname string")
    assert {(r.their_id, r.our_id, r.mapping) for r in evaluate.mapped(theirs, ours).collect()} == {(1, 10, "exact"), (2, 11, "unique"), (3, None, "unmapped")}
    run = spark.createDataFrame([("a", "X.__init__", 3), ("a", "n", 1)], "source_key string, target_key string, count long")
    st_ = spark.createDataFrame([("a", "X", "resolved")], "source_key string, target_key string, resolution_status string")
    assert {tuple(r) for r in evaluate.accounted(run, st_).collect()} == {("resolved", 1, 3), ("absent", 1, 1)}


def test_packing():
    items = [{"path": "a", "name": "n" * 50, "text": "t" * 4000, "outline": "o" * 800}, {"path": "b", "name": "m", "text": "u" * 9000}, {"path": "c", "name": "k"}]
    out = pack.pack(items, {"a": "h", "b": "i"}, 3500)
    assert [i["path"] for i in out["items"]] == ["a", "b", "c"] and "text" not in out["items"][0] and "outline" in out["items"][0] and out["files"] == {"a": "h", "b": "i"}
    assert pack.pack(items, {}, 1330)["next"] is not None and pack.encoded_size(out) <= 3500
    assert pack.budget_bytes(100, None) == 400 and pack.budget_bytes(None, 50) == 50
    with pytest.raises(ValueError):
        pack.budget_bytes(0, None)
    p, made = pack.Packets(2), []
    for k in (1, 2, 1, 3, 2):
        p.get((k,), lambda k=k: made.append(k) or {})
    assert made == [1, 2, 3, 2]


@given(st.text(max_size=60))
def test_jsonc_keeps_json(t):
    import json

    s = json.dumps({"k": t, "l": [1, 2]})
    assert json.loads(S.strip_jsonc(s.replace("]", ",]") if "]" not in t else s)) == {"k": t, "l": [1, 2]} or "]" in t


def test_driver_functions():
    assert S.last_object('x {"a": 1} y {"b": {"c": 2}} z {') == {"b": {"c": 2}}
    assert S.at_path({"a": [{"b": 5}]}, "a[0].b") == 5 and S.at_path({}, "a.b") is None
    assert S.schema_errors({"a": 1}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}) == ["$.b: missing", "$.a: not of type string"]
    assert S.join_path("a/b", "../c") == "a/c" and S.join_path("a", "../../c") is None
    with pytest.raises(ValueError):
        S.cursor_offset("!!", "g", "q")


COMMANDS = {
    "pytest -q": "check", "cd a/b && python -m pytest": "check", "ls; pytest": "check", "pytest; ls": "command", "pytest -q | tee log": "command", "pytest > log": "command", "pytest || true": "command", "pytest &": "command",
    "grep -rn pytest .": "command", "npm run test": "check", "npx jest": "check", "/usr/bin/pytest x": "check", "python3.12 -m unittest": "check", "python pytest.py": "command", "go test ./...": "check", "cargo build": "command", "yarn test": "check",
    "echo 'pytest; x'": "command", "echo 'open": "command", "": "command", "pytest &&": "command", "npx": "command", "''": "command",
}


@pytest.mark.parametrize(("line", "kind"), COMMANDS.items())
def test_command_kinds(line, kind):
    import json

    assert S.command_kind("Bash", {"command": line}) == kind and S.command_kind("exec_command", json.dumps({"cmd": line})) == kind


def test_calls_that_are_no_commands(spark):
    assert [S.command_kind(n, a) for n, a in (("Edit", {}), ("apply_patch", "x"), ("search", {"text": "how to run pytest"}), ("Bash", "no json"), ("Bash", [1]), ("Bash", {"command": 3}))] == ["edit", "edit", "tool", "command", "command", "command"]
    df = spark.createDataFrame([("Bash", '{"cmd": "pytest"}'), (None, "x"), ("Edit", None)], "n string, a string")
    assert [r[0] for r in df.select(S.command_kinds("n", "a")).collect()] == ["check", None, "edit"]


def test_exit_status(spark):
    import json

    rows = {
        '{"exit_code": 3, "output": "x"}': 3, '{"exit_code": 3}': None, '{"exit_code": true, "output": ""}': None, "Process exited with code 0": 0, "x\nExit code: -2\nOutput: y": -2, "Output: Exit code: 1": None, "it said exit code: 3": None, "x" * 600 + "\nExit code: 1": None,
        json.dumps([{"type": "text", "text": '{"exit_code": 7, "chunk_id": "c"}'}]): 7, json.dumps([{"type": "image", "text": '{"exit_code": 7, "chunk_id": "c"}'}]): None, "": None,
    }
    assert {k: S.exit_status(k) for k in rows} == rows and S.exit_status(None) is None
    got = spark.createDataFrame([(k,) for k in rows], "o string").select("o", S.exit_codes("o").alias("c")).collect()
    assert {r.o: r.c for r in got} == rows


def test_answer_paths(spark):
    rows = {" ./a//b.py ": "a/b.py", "a\\b": "a/b", "/a": None, "a/../b": None, "C:\\x": None, "": None, "././a": "a", "a/..b": "a/..b"}
    got = spark.createDataFrame([(k,) for k in rows], "p string").select("p", S.answer_path("p").alias("a")).collect()
    assert {r.p: r.a for r in got} == rows


def test_scalar_columns(spark):
    df = spark.createDataFrame([("getHTTPResponse_code2", "src/a.b/x.test.py", "ééé")], "n string, p string, t string")
    r = df.select(S.words("n").alias("w"), S.name_shape("n").alias("s"), S.suffix("p").alias("x"), S.stem("p").alias("m"), S.folder("p").alias("f"), S.ancestors("p").alias("a"), S.byte_prefix("t", F.lit(3)).alias("b"), S.name_shape(F.lit("get")).alias("none")).first()
    assert r.w == ["get", "http", "response", "code2"] and r.s == "get http response code 2|0|0" and (r.x, r.m, r.f) == (".py", "x.test", "src/a.b") and r.a == ["", "src", "src/a.b"] and r.b == "é" and r.none is None


def test_embedding_reuses_stored_vectors(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "source", 1, 2, "", "red"), ("b", "doc", 1, 2, "H", "blue"), ("c", "config", 1, 2, "", "x")], "path string, scope string, start_line int, end_line int, heading string, body string")
    rows = vector.inputs(chunks)
    assert sorted(r.input for r in rows.collect()) == ["a\nred", "b\nH\nblue"]
    load = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    one = vector.refreshed(rows, None, load, 2)
    one.write.parquet(f"{tmp_path}/v")
    kept = spark.read.parquet(f"{tmp_path}/v")
    more = vector.inputs(chunks.union(spark.createDataFrame([("d", "doc", 1, 1, "", "new")], chunks.schema)))
    fail = lambda: lambda texts: [[1.0, 0.0] if t == "d\nnew" else [0.0, 0.0] for t in texts]
    assert vector.refreshed(more, kept, fail, 2).count() == 3 and vector.to_embed(more, kept, "key").count() == 1
    assert vector.fresh(kept, more, ["key"]) and not vector.fresh(kept, rows.limit(1), ["key"])


def test_commands_parse(capsys, monkeypatch):
    import io

    from graphloom import __main__ as cli

    a = cli.parser().parse_args(["--index", "i", "callers", "x", "--depth", "2"])
    assert (a.command, a.name, a.depth, a.candidates) == ("callers", "x", 2, False)
    monkeypatch.setattr("sys.stdin", io.StringIO("ok\na.ts(1): error TS1: x\n"))
    assert cli.main(["reduce-output", "tsc", "2"]) == 0 and capsys.readouterr().out == "a.ts(1): error TS1: x\n"

    class Fake:
        def trace_path(self, s, t):
            return {"path": f"{s} > {t}"}

    assert cli.run(cli.parser().parse_args(["trace", "a", "b"]), Fake()) == {"path": "a > b"}
