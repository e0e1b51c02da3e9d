
import corpus_pipeline
import pytest

from graphloom.llm import pieces, toxicity

from .test_dedup import near_truth
from .test_models import toxic_corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [r for r in toxic_corpus(400)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in rows]
    docs += [(1000 + i, docs[4 * i + 1][1], "en", "s0", 1) for i in range(10)]  # exact copies
    docs += [(2000 + i, docs[4 * i + 2][1] + " more words", "en", "s1", 1) for i in range(10)]  # near copies
    docs += [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    score = toxicity.scores(model, [(t or "").encode() for _, t, _ in rows])
    step, expect = docs, [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns
        if name == "exact dedup":
            last = {}
            for i, t, s in expect:
                last[t or ""] = max(last.get(t or "", -1), i)
            expect = [r for r in expect if last[r[1] or ""] == r[0]]
        if name == "near dedup":
            truth = near_truth(expect)
            expect = [r for r in expect if truth[r[0]][1] == r[0]]
        assert sorted((r.doc_id, r.text or "") for r in step.collect()) == sorted((i, t or "") for i, t, _ in expect), name
    clean = [i for i, _, _ in rows if i < 400 and i % 4]
    assert len({i for i, _, _ in expect} & set(clean)) > 0.9 * len(clean) - 20


def test_run_encodes_whole_texts(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    v = pieces.load()
    assert out
    for r in out[:50]:
        t = texts[r.doc_id]
        assert (r.piece_ids is None) == (t is None) and (t is None or list(pieces.encode(v, [t.encode()])[0]) == list(r.piece_ids))


def test_stages_leave_only_their_last_output(spark, folder):
    """Scratch tables of stages, and the outputs that a later stage has read, are gone when run() returns."""
    import os

    from graphloom.operators.settle import shared_dir

    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, folder)
    left = {f"{d}/{x}" for d in set(os.listdir(root)) - before for x in os.listdir(f"{root}/{d}")}
    assert len(left) == 1 and "/encode-" in left.pop() and out.count() > 0


def test_temporary_removes_what_was_made_inside(spark):
    from graphloom.llm.common import Scratch, temporary

    outer = Scratch(spark, "outer")
    kept = outer.save(spark.range(3))
    with pytest.raises(ZeroDivisionError):
        with temporary():
            inner = Scratch(spark, "inner").save(spark.range(5))
            assert inner.count() == 5
            1 / 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner._scratch)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) and kept.count() == 3
