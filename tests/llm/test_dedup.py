import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exactdup, fuse, neardup
from graphloom.llm.common import Scratch
from graphloom.llm.components import components

from .conftest import EDGES


def test_fuse_filter_has_its_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 30000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = fuse.build(keys)
        assert fuse.contains(f, keys).all()
        others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
        assert fuse.contains(f, others).mean() < 0.002
    assert len(f) < 30000 * 2.6


def exact_truth(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}


def test_exact_duplicates_edges(edges, nothing):
    got = exactdup.exact_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == exact_truth(EDGES)
    # one row of a text stays, the repeated one goes
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert exactdup.exact_duplicates(nothing).count() == 0


def test_byte_check_parts_texts_of_one_digest(frame):
    rows = [(i, f"text {i % 40}", "s") for i in range(400)]
    got = exactdup.exact_duplicates(frame(rows), chars=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == exact_truth(rows)


def test_drop_exact_duplicates_keeps_columns_and_one_of_each(edges):
    out = exactdup.drop_exact_duplicates(edges)
    assert out.columns == edges.columns
    assert sorted((r.text or "") for r in out.collect()) == sorted({t or "" for _, t, _ in EDGES})


def near_truth(rows, percent=75):
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            ws = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
            sets.setdefault(i, set()).update({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_edges(edges, nothing):
    got = neardup.near_duplicates(edges).collect()
    truth = near_truth(EDGES)
    assert len(got) == len(EDGES)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*truth[r.doc_id], truth[r.doc_id][1] == r.doc_id)
    assert neardup.near_duplicates(nothing).count() == 0


def corpus(n, seed):
    """Random texts, chains of edits, a shared passage, a large group of near copies."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base, rows = text(60), text(120), []
    for i in range(n):
        if i % 4 == 0:
            ws = list(base)
            for _ in range(rng.randrange(1, 12)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        elif i % 4 == 1 and i > 8:
            ws = rows[rng.randrange(len(rows))][1].split()
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = text(rng.randrange(1, 90)) + (passage if i % 3 == 0 else [])
        rows.append((i, " ".join(ws), "s"))
    return rows


@pytest.mark.parametrize("blocks", [(1024, 256, 256), (8, 6, 256), (8, 6, 3)])
def test_near_duplicates_equal_brute_force(frame, monkeypatch, blocks):
    """Small blocks send large groups through block pairs, pivots and the second pass."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(neardup, "SET_BLOCK", blocks[1])
    monkeypatch.setattr(neardup, "PAIR_BLOCK", blocks[2])
    rows = corpus(240, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == near_truth(rows)


def test_links_at_the_bound(frame):
    ws = [f"t{i}" for i in range(18)]  # 14 shingles
    rows = [(1, " ".join(ws), "s"), (2, " ".join(ws[:16]), "s"), (3, " ".join(ws[:14]), "s"), (4, " ".join(ws[2:14]), "s")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == {i: c for i, (_, c) in near_truth(rows).items()}


def test_sketches_tell_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 90).astype(np.uint64)])
    sig = np.stack([neardup.samples(np.unique(x)) for x in (a, b, rng.integers(0, 1 << 63, 800).astype(np.uint64))])
    sk = neardup.sketches(sig)
    flips = lambda i, j: int(np.bitwise_count(sk[i] ^ sk[j]).sum())
    assert flips(0, 0) == 0 and flips(0, 1) <= neardup.most_flips(0.75) < flips(0, 2)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 5)]
    rng.shuffle(pairs)
    got = dict(components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[202] == 200 and 300 not in got
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_drop_near_duplicates(edges):
    out = neardup.drop_near_duplicates(edges)
    assert out.columns == edges.columns
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert kept.count(None) == 2 and 2 not in kept and 6 not in kept and 11 not in kept and {1, 3, 4, 5, 7, 8, 9, 10} <= set(kept)
    assert out.where(F.col("doc_id") == 1).count() == 1
