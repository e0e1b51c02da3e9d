import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import logs, observe, settle, snapshot
from graphloom.sources import ignore, repo, small, transcripts
from graphloom.streaming import fold


@pytest.fixture
def tree(tmp_path):
    files = {
        ".gitignore": "ignored.txt\n*.log\n!keep.log\nbuild/\n/only_root.txt\n", "src/app.py": "def a(): pass\n", "tests/test_app.py": "x", "README.md": "# hi", "pyproject.toml": "", "ignored.txt": "i", "a.log": "l", "keep.log": "k",
        "build/x.py": "b", "src/.gitignore": "!a.log\nsecret_*\n", "src/a.log": "kept", "src/secret_1": "s", "src/only_root.txt": "o", ".git/config": "g", ".env": "K=1", "vendor/v.py": "v", "src/x.min.js": "m", "src/gen.py": "# @generated\n",
        "src/long.js": "x" * 2000, "node_modules/n.js": "n", "only_root.txt": "r",
    }
    for p, t in files.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bin.dat").write_bytes(b"\0\1")
    (tmp_path / "latin.txt").write_bytes(b"\xe9")
    os.symlink(tmp_path / "README.md", tmp_path / "link.md")
    return tmp_path


def test_scan(spark, tree):
    got = {r.path: r for r in repo.scan(spark, str(tree)).collect()}
    assert set(got) == {".gitignore", "src/app.py", "tests/test_app.py", "README.md", "pyproject.toml", "keep.log", "src/.gitignore", "src/a.log", "src/only_root.txt", ".env", "vendor/v.py", "src/x.min.js", "src/gen.py", "src/long.js", "bin.dat", "latin.txt"}
    kinds = {p: r.kind for p, r in got.items()}
    assert kinds["src/app.py"] == "source" and kinds["tests/test_app.py"] == "test" and kinds["README.md"] == "doc" and kinds["pyproject.toml"] == "config"
    assert kinds["vendor/v.py"] == "vendor" and kinds["src/x.min.js"] == kinds["src/gen.py"] == kinds["src/long.js"] == "generated"
    assert got["bin.dat"].omission == "binary" and got["latin.txt"].omission == "not UTF-8" and got[".env"].omission == "excluded path" and got[".env"].text is None
    assert got["src/app.py"].content_hash == repo.fingerprint(b"def a(): pass\n")


def test_store_reader_has_the_same_files(spark, tree):
    got = {r.path: r for r in repo.from_store(spark, f"file://{tree}").collect()}
    assert got["src/app.py"].text == "def a(): pass\n" and got["src/gen.py"].kind == "generated" and "node_modules/n.js" not in got


@pytest.mark.parametrize(
    ("rule", "hits", "misses"),
    [("*.pyc", ["a.pyc", "b/a.pyc"], ["a.py"]), ("/x", ["x"], ["a/x"]), ("a/b", ["a/b"], ["c/a/b"]), ("doc/**/z", ["doc/z", "doc/a/b/z"], ["z"]), ("**/y", ["y", "a/y"], ["yy"]), ("f?[ab]", ["fxa"], ["fxc", "f/a"]), ("d/**", ["d/x/y"], ["d"]), ("[!a]x", ["bx"], ["ax"]), (r"\#h", ["#h"], ["h"])],
)
def test_ignore_patterns(rule, hits, misses):
    nested = [("", ignore.rules(rule))]
    assert all(ignore.ignored(h, False, nested) for h in hits) and not any(ignore.ignored(m, False, nested) for m in misses)


def test_config_digest():
    texts = {"tsconfig.json": '{"extends": "./b"}', "b.json": "{}"}
    a = repo.config_digest(texts.get, [("src/a.ts", "source")])
    assert a == repo.config_digest(texts.get, [("src/a.ts", "source"), ("docs/x.md", "doc")])
    assert a != repo.config_digest({**texts, "b.json": '{"x": 1}'}.get, [("src/a.ts", "source")])


def lines_a():
    use = lambda n: {"type": "event_msg", "timestamp": "t", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n - 10, "cached_input_tokens": 5, "output_tokens": 10, "total_tokens": n}}}}
    return [use(110), {"type": "response_item", "timestamp": "t", "payload": {"type": "function_call", "call_id": "c1", "name": "exec_command", "arguments": '{"cmd": "pytest -q"}'}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": '{"exit_code": 1, "output": "E"}'}}, use(210)]


def lines_b():
    msg = lambda i, o, side=False, **c: {"type": "assistant", "timestamp": "t", "isSidechain": side, "message": {"id": i, "model": "m", "usage": {"input_tokens": 100, "cache_creation_input_tokens": 20, "cache_read_input_tokens": 30, "output_tokens": o}, **c}}
    return [msg("a", 1), msg("a", 10), msg("a", 5), msg("b", 10, content=[{"type": "tool_use", "id": "u1", "name": "Edit", "input": {"p": 1}}]), msg("z", 999, side=True), {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "is_error": False}]}}]


@pytest.fixture
def sessions(tmp_path):
    for name, rows in (("a.jsonl", lines_a()), ("b.jsonl", lines_b())):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows) + ("{broken\n" if name[0] == "a" else ""))
    return tmp_path


def test_reports_count_usage_once(spark, sessions):
    a = transcripts.events(transcripts.lines(spark, f"{sessions}/a.jsonl"), "a")
    b = transcripts.events(transcripts.lines(spark, f"{sessions}/b.jsonl"), "b")
    assert a.where("kind = 'malformed'").count() == 1
    got = {r.client: r for r in logs.attention(logs.session_reports(a.unionByName(b))).collect()}
    assert got["a"].total_tokens == 210 and got["a"].n_calls == 1 and got["a"].n_failed == 1 and "most calls failed" in got["a"].attention
    assert got["b"].total_tokens == 320 and got["b"].unchecked_edits and got["b"].has_children and got["b"].warnings == ["child sessions left out"]


def test_stream_folds_to_the_batch(spark, sessions, tmp_path):
    for client, total, calls in (("a", 210, 1), ("b", 320, 1)):
        src, out = tmp_path / f"in_{client}", f"{tmp_path}/out_{client}"
        src.mkdir()
        rows = lines_a() if client == "a" else lines_b()
        schema = transcripts.EVENT
        data = transcripts.events(spark.createDataFrame([(json.dumps(r), f"s_{client}", i) for i, r in enumerate(rows)], "value string, file string, seq long"), client)
        for k in range(2):
            data.where(F.col("seq") % 2 == k).coalesce(1).write.mode("append").json(str(src))
        data.where("seq = 0").coalesce(1).write.mode("append").json(str(src))  # delivered twice
        q = (
            fold.fold(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp_{client}")
            .foreachBatch(lambda df, n, out=out: fold.publish(df, n, out)).trigger(availableNow=True).start()
        )
        assert q.awaitTermination(180) and q.exception() is None
        last = max(int(d[2:]) for d in os.listdir(out) if d.startswith("v="))
        (r,) = spark.read.parquet(f"{out}/v={last}").collect()
        assert (r.total_tokens, r.n_calls) == (total, calls)


def test_junit(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuites><testsuite name="s" tests="5" failures="1" errors="0"></testsuite><testsuite name="t" tests="2" skipped="2"></testsuite></testsuites>')
    assert sorted(tuple(r) for r in transcripts.junit(spark, str(tmp_path / "j.xml")).collect()) == [("s", 5, 1, 0, 0), ("t", 2, 0, 0, 2)]


def test_generations_are_swapped_whole(spark, tmp_path):
    store = snapshot.Store(spark, f"file://{tmp_path}/store")
    assert store.generation() is None
    one = store.publish({"nodes": spark.range(3).toDF("node_key")}, build=1)
    assert store.generation() == one and store.table("nodes").count() == 3 and not store.crashed()
    with pytest.raises(RuntimeError):
        store.publish({"nodes": spark.range(9).toDF("node_key")}, check=lambda: False)
    assert store.generation() == one and store.crashed()
    two = store.publish({"nodes": spark.range(5).toDF("node_key")})
    assert store.table("nodes").count() == 5 and store.table("nodes", one).count() == 3 and store.metadata()["previous"] == one and two != one


def test_artifacts(spark, tmp_path):
    t = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    keys = [r.key for r in snapshot.save_artifacts(t, f"{tmp_path}/art").collect()]
    assert len(keys) == 2 and snapshot.save_artifacts(t, f"{tmp_path}/art").count() == 0
    assert sorted(snapshot.artifact(spark, f"{tmp_path}/art", k) for k in keys) == ["x", "y"] and snapshot.artifact(spark, f"{tmp_path}/art", keys[0][:-1] + "z") is None


def test_reports_show_unknown(tmp_path):
    assert "unknown" in snapshot.markdown([{"a": None, "b": 0}], ["a", "b"], "t") and "&lt;b&gt;" in snapshot.dashboard([{"a": "<b>"}], ["a"], "t")


def test_tail_holds_back_partial_lines_and_notices_another_file(spark, tmp_path):
    from graphloom.sources.tail import TailDataSource, _Tail

    f = tmp_path / "t.jsonl"
    f.write_bytes(b'{"a": 1}\n{"a": 2}\n{"a"')
    r = _Tail(str(f))
    rows, one = r.read(r.initialOffset())
    assert [v for _, _, v in rows] == ['{"a": 1}', '{"a": 2}'] and one["at"] == 18
    f.write_bytes(f.read_bytes() + b": 3}\n")
    rows, two = r.read(one)
    assert list(rows) == [(0, 18, '{"a": 3}')] and list(r.readBetweenOffsets(one, two)) == [(0, 18, '{"a": 3}')]
    assert list(r.read(two)[0]) == []
    f.write_bytes(b"new\n")
    rows, three = r.read(two)
    assert list(rows) == [(1, 0, "new")] and three["epoch"] == 1

    spark.dataSource.register(TailDataSource)
    out = f"{tmp_path}/out"
    for text in (b"x\ny\n", b"x\ny\nz\npart"):
        f.write_bytes(text)
        q = spark.readStream.format("tail").load(str(f)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", out).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.seq, r.value) for r in spark.read.parquet(out).collect()) == [(0, "x"), (2, "y"), (4, "z")]


def test_yaml_subset_is_strict():
    assert small.yaml_subset("") is None and small.yaml_subset('a:\n- 1\n- b: "x"\n  c: []\n') == {"a": [1, {"b": "x", "c": []}]}
    for bad in ("a: plain", "a\n", "a: 1\n  b: 2\n", '- "x" "y"\n'):
        with pytest.raises(ValueError):
            small.yaml_subset(bad)


def test_observer_keeps_failures(spark, tmp_path):
    seen = observe.Observer(lambda: "g", first=10)
    with pytest.raises(ZeroDivisionError):
        seen.call("t", lambda: 1 / 0)
    seen.append(spark, f"{tmp_path}/ledger")
    rows = spark.read.parquet(f"{tmp_path}/ledger").orderBy("seq").collect()
    assert [(r.seq, r.phase, r.status) for r in rows] == [(11, "invoked", None), (12, "completed", "ZeroDivisionError")] and rows[0].observation_id == rows[1].observation_id and seen.records == []


def test_old_generations_are_pruned(spark, tmp_path):
    store = snapshot.Store(spark, f"file://{tmp_path}/store")
    made = [store.publish({"t": spark.range(n)}) for n in (1, 2, 3)]
    assert store.prune() == made[:1] and store.table("t").count() == 3 and store.table("t", made[1]).count() == 2 and store.prune() == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        named = None

        def get(self, key, default):
            return self.named

    class Context:
        master, applicationId = "spark://host:7077", "app-x"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        settle.shared_dir(Session())
    Conf.named = "hdfs://n/x/"
    assert settle.shared_dir(Session()) == "hdfs://n/x"


def test_bounded_state_of_a_stream(monkeypatch):
    """More events and messages than the state keeps: counts stay those of every event once, repeats and replays aside."""
    import random

    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    monkeypatch.setattr(fold, "RECENT", 50)
    monkeypatch.setattr(fold, "OPEN", 10)
    rng, state = random.Random(1), State()
    rows = [{"seq": i, "client": "b", "kind": "usage" if i % 3 else "call", "message_id": f"m{i // 4}", "total_tokens": float(rng.randrange(100)) if i % 3 else None, "sidechain": i % 10 == 9, "event_id": f"{i}:e"} for i in range(1000)]
    for a in range(0, 1000, 40):
        part = rows[a : a + 40]
        rng.shuffle(part)
        again = part + rows[max(0, a - 30) : a] + rows[:5]  # late repeats, and a replay from the start
        (out,) = fold._fold(("s",), iter([pd.DataFrame(again)]), state)
    own = [r for r in rows if not r["sidechain"]]
    per = {}
    for r in own:
        if r["kind"] == "usage":
            per[r["message_id"]] = max(per.get(r["message_id"], 0), r["total_tokens"])
    r = out.iloc[0]
    assert (r.n_events, r.n_children, r.n_calls, r.total_tokens, r.last_seq) == (len(own), 100, sum(x["kind"] == "call" for x in own), sum(per.values()), 999)
    assert len(state.get[-1]) < 5000 and len(state.get[-2]) < 1000
