"""Queries and operators on crowded keys and odd inputs, beside the SQL of the same result."""

import random
import threading
from collections import defaultdict
from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import graph, reports
from graphloom.plans import star

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem conversations".split()


@pytest.fixture
def tables(tmp_path):
    """f(name=select) -> folder, connection: the smallest tables, of which some are replaced by a select over the others."""

    def build(**selects):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW old_{t} AS SELECT * FROM '{SF}/{t}.parquet'")
            con.execute(f"COPY ({selects.get(t, f'SELECT * FROM old_{t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return build


def same(spark, sf_dir, con, name):
    """The rows of a query, which are those of its SQL."""
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    got = order(df.collect())
    assert got == order(cur.fetchall())
    return got


@contextmanager
def within(spark, seconds):
    """Jobs that go on for longer are cancelled, which fails them."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_a_question_for_regions_is_not_cut_by_a_crowd_of_suppliers(spark, tables):
    d, con = tables(supplier="SELECT s_suppkey + i AS s_suppkey, s_name, 7::INTEGER AS s_nationkey, s_acctbal FROM (SELECT * FROM old_supplier LIMIT 1), range(2100) r(i)")
    assert same(spark, d, con, "reach_limited") == [(False, 1, None), (True, 0, "edges")]
    # with suppliers the question meets the limit of nodes, as before
    nation = spark.createDataFrame([("nation::7",)], "node_key string")
    assert graph.limited(star.published(spark, d), nation, 1).reason == "nodes"


def test_words_of_requests_start_after_letters_beyond_ascii(spark, tables):
    texts = ["ütest", "ä bug", "néerror", "éadd", "你how", "ЖtestЖ", "5test", "_fix", "latest", "TEST", "İmplement", "fİx", "Kclean", "ßtest why", "", None]
    values = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(texts))
    d, con = tables(conversations=f"SELECT i::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, t AS text FROM (VALUES {values}) v(i, t)")
    got = {i: kinds for i, _, kinds in same(spark, d, con, "task_activities")}
    assert [got[i] for i in range(len(texts))] == ["test", "fix", "fix", "feature", "explain", "test", "", "", "", "test", "feature", "fix", "", "explain,test", "", ""]


def linked(pairs):
    """A frame of two columns as resolved edges."""
    a, b = pairs.columns
    return pairs.select(F.col(a).alias("source_key"), F.col(b).alias("target_key"), F.lit("CALLS").alias("relation"), F.lit(0.95).alias("confidence"), F.lit("import_map").alias("resolution_tier"), F.lit("resolved").alias("resolution_status"))


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_random_graphs(spark, monkeypatch, seed):
    """Sparse to dense, with cycles, loops and repeats; ends with one edge into them and with several; many blocks and tasks."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    monkeypatch.setattr(graph, "TASK_ROWS", 5)
    r, n = random.Random(seed), (30, 16, 24, 9)[seed]
    pairs = [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(int(n * (1.2, 1.6, 2.0, 1.4)[seed]))]
    pairs += [(f"v{r.randrange(n)}", f"leaf{i}") for i in range(12)] + pairs[:3]
    to = defaultdict(set)
    for a, b in pairs:
        if a != b:
            to[a].add(b)
    want = []
    for a in list(to):
        found = defaultdict(list)
        for m in to[a]:
            for k in to.get(m, set()) - {a}:
                for b in to.get(k, set()) - {a, m}:
                    found[b].append(f"{a} > {m} > {k} > {b}")
        near = to[a] | {x for m in to[a] for x in to.get(m, ())}
        want += [(a, b, paths[0]) for b, paths in found.items() if len(paths) == 1 and b not in near]
    got = graph.chains(linked(spark.createDataFrame(pairs, "a string, b string")))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_chains_through_a_crowd_are_counted_before_they_multiply(spark):
    """2.7 billion paths, of which none is single, beside 3,000 that are."""
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    i = F.col("id")
    pairs = spark.range(900_000).select(name("a", i % 3000).alias("a"), name("m", F.floor(i / 3000)).alias("b"))
    pairs = pairs.union(spark.range(300).select(name("m", i), F.lit("n"))).union(spark.range(3000).select(F.lit("n"), name("b", i)))
    pairs = pairs.union(spark.createDataFrame([("one", "m7")], "a string, b string"))
    with within(spark, 100):
        got = graph.chains(linked(pairs)).collect()
    assert len(got) == 3000 and {r.source_key for r in got} == {"one"} and ("one", "b12", "one > m7 > n > b12") in map(tuple, got)


def shuffled(spark):
    """Bytes of shuffle files that the application has written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_chains_of_tables_need_little_disk(spark, tables, tmp_path):
    """Edges of other relations are left where they are, and starts and edges are not dealt out again and again; rows follow each other by their ends."""
    d, con = tables()
    before = shuffled(spark)
    got = entry.queries()["chains_three_hops"](spark, d)
    got.write.parquet(out := str(tmp_path / "out"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert shuffled(spark) - before < 60 * lines
    same(spark, d, con, "chains_three_hops")
    n, runs = con.execute(f"SELECT count(*), count(*) FILTER (again) FROM (SELECT lag(source_key) OVER (PARTITION BY filename ORDER BY file_row_number) = source_key AS again FROM read_parquet('{out}/*.parquet', filename = true, file_row_number = true))").fetchone()
    assert n and runs > 0.8 * n


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_blocks_of_starts_and_ends(spark, monkeypatch, seed):
    """Starts and ends of a node in several blocks, and graphs in which no node, or every node, has several edges into it."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    monkeypatch.setattr(graph, "HELD", 3)
    monkeypatch.setattr(graph, "TASK_ROWS", 5)
    r = random.Random(seed)
    pairs = [(f"a{i}", f"m{i % 3 if seed else i}") for i in range(11)] + [(f"m{i}", "n") for i in range(3 if seed > 1 else 1)] + [("n", f"b{i}") for i in range(10)] + [("n", "n")]
    if seed:
        pairs += [("n", "a1"), ("b1", "a2"), ("b2", "a2")] + [(f"{r.choice('abm')}{r.randrange(3)}", f"{r.choice('abm')}{r.randrange(6)}") for _ in range(6)]
    if seed == 3:
        pairs += [("x", b) for b in sorted({b for _, b in pairs})] + [("y", b) for b in sorted({b for _, b in pairs})]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    want = con.execute("""WITH y AS (SELECT DISTINCT a, b FROM p WHERE a <> b), two AS (SELECT x.a, x.b AS m, z.b FROM y x JOIN y z ON x.b = z.a WHERE x.a <> z.b),
        three AS (SELECT two.a, two.m, two.b AS n, y.b FROM two JOIN y ON two.b = y.a WHERE two.a <> y.b AND two.m <> y.b),
        o AS (SELECT a, b, min(a || ' > ' || m || ' > ' || n || ' > ' || b) AS path FROM three GROUP BY a, b HAVING count(*) = 1)
        SELECT * FROM o WHERE NOT EXISTS (FROM y WHERE y.a = o.a AND y.b = o.b) AND NOT EXISTS (FROM two WHERE two.a = o.a AND two.b = o.b)""").fetchall()
    got = graph.chains(linked(spark.createDataFrame(pairs, "a string, b string")))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_spans_told_before_are_found_by_ranges(spark, seed):
    """Long and short spans, equal ones, ties of places, lines below 0, ends before starts, nulls."""
    r = random.Random(seed)
    some = lambda v: None if r.random() < 0.03 else v
    rows = []
    for _ in range(250):
        a = r.randrange(-40, 3000)
        rows.append((some(r.choice("abc")), some(a), some(a + r.choice([0, 0, 1, 3, 8, 31, 200, -1, -25])), some(r.randrange(200)), len(rows)))
    hides = lambda y, x: None not in (*x, *y) and y[0] == x[0] and y[3] < x[3] and x[1] <= y[2] and y[1] <= x[2]
    want = {x[4] for x in rows if not any(hides(y, x) for y in rows)}
    got = reports.unrepeated(spark.createDataFrame(rows, "path string, start_line int, end_line long, place int, id int"))
    assert got.columns == ["path", "start_line", "end_line", "place", "id"] and 0 < len(want) < len(rows)
    assert sorted(x.id for x in got.collect()) == sorted(want)


def test_spans_of_one_crowded_file_are_not_met_in_pairs(spark):
    """400,000 spans of a file that don't overlap, and as many that each repeat one of them."""
    i = F.col("id")
    first = spark.range(400_000).select(F.lit("f").alias("path"), (i * 10).alias("start_line"), (i * 10 + i % 10).alias("end_line"), i.alias("place"))
    again = spark.range(400_000).select(F.lit("f"), i * 10 - i % 7, i * 10, i + 400_000)
    with within(spark, 100):
        got = reports.unrepeated(first.union(again)).agg(F.count("*"), F.max("place")).first()
    assert tuple(got) == (400_000, 399_999)


def test_spans_of_crowded_brands(spark, tables):
    d, con = tables(part="SELECT p_partkey + i * 1000 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM old_part, range(20) r(i)")
    assert same(spark, d, con, "overlap_spans")
