import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    show = lambda v: "None" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        return
    cur = con.execute(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry_and_without_the_training_part(spark, monkeypatch):
    assert entry.entry(spark).count() > 0
    for name in [m for m in sys.modules if m.startswith(("graphloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "pipeline" not in bare.queries() and set(NAMES) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
