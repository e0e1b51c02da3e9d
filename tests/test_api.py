import os

import pytest

from graphloom.api import Engine

from .test_resolution import JS, PY


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    more = {"README.md": "# Guide\nHow the mailer delivers letters.\n", "AGENTS.md": "rules\n", "tests/test_core.py": "from pkg.core import helper\ndef test_h():\n    helper(1)\n", "web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./*"]}}}'}
    for p, t in {**PY, **JS, **more}.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}/store")
    out = e.scan(str(tree))
    assert out["rebuilt"] and out["edges"]["CALLS"] > 5 and out["state"] == "not_indexed"
    return e


def test_questions(engine):
    assert [r["symbol_id"] for r in engine.find_symbol("helper").items] == ["pkg/core.py::helper"]
    assert [r["path"] for r in engine.find_files("test").items] == ["tests/test_core.py"]
    got = {r["node_key"]: r["distance"] for r in engine.callers("helper", 2).items}
    assert got["pkg/app.py::App.go"] == 1 and got["tests/test_core.py::test_h"] == 1 and "main.py" not in got  # its call is only a candidate
    assert engine.callers("App.go").limit_reason
    assert engine.trace_path("pkg/app.py::App.go", "pkg/core.py::helper")["hops"] == 1
    assert {r["node_key"] for r in engine.impact(["helper"], scopes=("test",)).items} >= {"tests/test_core.py::test_h"}
    assert [r["name"] for r in engine.list_symbols("pkg/core.py").items] == ["Base", "run", "stop", "helper"]
    with pytest.raises(LookupError):
        Engine(engine.spark, engine.store.root + "-none").find_files()


def test_context_and_read(engine):
    out = engine.context("how does the mailer deliver", ["pkg.nope", "helper"])
    assert out["unresolved"] == ["pkg.nope"] and out["items"][0]["reason"] == "exact" and any(i["path"] == "README.md" for i in out["items"]) and "AGENTS.md" in out["instructions"]
    h = out["files"]["README.md"]
    assert engine.read("README.md", 1, 1, h) == "# Guide\n" and engine.read("README.md", 1, 1, "0") is None


def test_rescan_is_incremental(engine, tree):
    before = engine.store.generation()
    assert not engine.scan(str(tree))["rebuilt"] and engine.doctor(str(tree))["state"] == "ready"
    (tree / "util.py").write_text("def only_here(): pass\ndef second(): only_here()\n")
    assert engine.doctor(str(tree))["changed"] == ["util.py"]
    out = engine.scan(str(tree))
    assert out["rebuilt"] and out["changed"] == ["util.py"]
    assert {(r.node_key, r.change) for r in engine.changed(before).collect()} >= {("util.py::second", "added"), ("util.py::Bag", "removed")}
    assert any(r["node_key"] == "util.py::second" for r in engine.callers("only_here", 1).items)
    assert engine.fresh(str(tree), lambda e: e.find_symbol("second").items[0]["name"]) == "second"
    with pytest.raises(RuntimeError):
        engine.fresh(str(tree), lambda e: (tree / "util.py").write_text((tree / "util.py").read_text() + "# more\n"))


def test_artifacts_and_export(engine, tmp_path):
    (key,) = engine.artifact_save(["a text"])
    assert engine.artifact_read(key) == "a text"
    engine.export(f"file://{tmp_path}/out", "r", "sha")
    assert engine.spark.read.json(f"file://{tmp_path}/out/edges").count() > 5
