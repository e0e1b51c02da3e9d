import hashlib
import random
from collections import defaultdict

from graphloom.llm import mixing

from .conftest import EDGES


def targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            return {s: share.get(s, epochs * sizes[s]) for s in names}
        capped |= above


def words(text):
    return len((text or "").encode().split())


def served(rows, want):
    """Words taken of each (doc_id, size), by sorting every copy of every document."""
    names = {s: k for k, s in enumerate(sorted((s for s in want if s is not None)) + [None])}
    order = lambda r: (int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, r[1])
    copies, total = [], sum(words(t) for _, t, _ in rows)
    for s in want:
        docs = sorted(((i, words(t)) for i, t, x in rows if x == s), key=order)
        stop = 0
        for _ in range(3):
            for i, n in docs:
                stop += n
                if n:
                    copies.append((stop / want[s], names[s], stop, i, n))
    taken, left = defaultdict(int), total
    for *_, i, n in sorted(copies, key=lambda c: c[:3]):
        taken[i, n] += min(n, left)
        left -= min(n, left)
    return taken


def check(rows, got):
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = targets(dict(sizes))
    for s, t in target.items():
        assert abs(t - want[s]) < 1e-6 * max(1, want[s])
        # no source is short by more than the document in service, nor has more than what the others are short by
        assert taken[s] >= t - longest[s] - 1 and taken[s] <= t + sum(longest.values()) - longest[s] + 1
    assert len(got) == len(rows) and sum(taken.values()) == sum(sizes.values())
    truth, mine = served(rows, {s: t for s, t in target.items() if t}), defaultdict(int)
    for r in got:
        mine[r.doc_id, r.size] += r.taken
    assert {k: n for k, n in mine.items() if n} == {k: n for k, n in truth.items() if n}


def test_edges(edges, nothing):
    check(EDGES, mixing.mix(edges).collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_targets_over_many_sources_and_reruns(frame):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), f"s{min(rng.randrange(40), rng.randrange(40))}") for i in range(3000)]
    a = mixing.mix(frame(rows)).collect()
    check(rows, a)
    b = mixing.mix(frame(rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in a} == {(r.doc_id, r.taken) for r in b}


def test_small_windows_give_the_same(frame, monkeypatch):
    rows = [(i, "w " * (i % 13), "ab"[i % 7 == 0]) for i in range(500)]
    a = {(r.doc_id, r.taken) for r in mixing.mix(frame(rows)).collect()}
    monkeypatch.setattr(mixing, "RUN", 4)
    monkeypatch.setattr(mixing, "SPANS", 3)
    assert a == {(r.doc_id, r.taken) for r in mixing.mix(frame(rows)).collect()}


def test_one_hot_source(frame):
    rows = [(i, "w " * 10, "hot" if i % 3 else f"s{i}") for i in range(900)]
    check(rows, mixing.mix(frame(rows)).collect())


def test_the_cut_leaves_copies_out_and_one_in_part(frame):
    """Copies behind the cut are left out by the global order, whatever their source has had."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 90), f"s{i % 5}") for i in range(600)]
    got = mixing.mix(frame(rows)).collect()
    check(rows, got)
    q = mixing.queue(frame(rows), (5, 2, 1), 3, "")
    late = [r for r in q.rows.collect() if (r.before + r.size) / r.target > q.cut.finish]
    assert late and all(r.taken == 0 for r in got if r.doc_id in {x.doc_id for x in late}) and 0 < q.cut.words


def test_mixture_takes_whole_documents(frame):
    rows = [(i, "w " * 10, "a" if i < 20 else "b") for i in range(200)]
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(rows)).collect()}
    out = mixing.mixture(frame(rows))
    n = defaultdict(int)
    for r in out.collect():
        n[r.doc_id] += 1
    assert out.columns == frame(rows).columns and all(n[i] == int(t / 10 + 0.5) for i, t in taken.items())


def test_mixture_equals_the_mix_on_edges(frame):
    """Documents without words stay once, repeated rows go together, and texts of any source are decided alike."""
    rng = random.Random(2)
    rows = [r for r in EDGES if r[0] not in (2, None)] + [(100 + i, "w " * rng.randrange(1, 40), f"s{i % 4}") for i in range(300)]
    taken = {(r.doc_id, r.source): (r.taken, r.size) for r in mixing.mix(frame(rows)).collect()}
    n = defaultdict(int)
    for r in mixing.mixture(frame(rows)).collect():
        n[r.doc_id, r.source] += 1
    for k, (t, size) in taken.items():
        assert n[k] == (1 if not size else int(t / size + 0.5)), k
    assert mixing.mixture(frame(EDGES)).count() > 0
