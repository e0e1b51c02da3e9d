import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import lm, media, pieces, toxicity

from .conftest import EDGES


# -- toxicity


def toxic_corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        ws = [rng.choice(vocab) for _ in range(rng.randrange(30, 120))]
        if bad:
            for _ in range(8):
                ws[rng.randrange(len(ws))] = rng.choice(["zzworthlessq", "zzidiotqq", "zzpathetick", "zzscumbag"])
        rows.append((i, " ".join(ws), "s", int(bad)))
    return rows


def test_toxicity_held_out_accuracy_and_edges(frame, spark, nothing):
    rows = toxic_corpus(800)
    docs = frame([r[:3] for r in rows] + [(100000 + k, t, s) for k, (_, t, s) in enumerate(EDGES)] + [(None, None, None)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (3, 1, None), (5, 0, 0), (5, 0, 0), (999999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_marks_are_the_words_typical_of_toxic_windows():
    good = [b" the cat sat ", b" a dog ran ", b" the rare word "] * 40
    bad = [b" the bad cat ", b" bad dog ", b" the cat sat "] * 20 + [b" the once word "]
    found = toxicity.marks(good, bad, 100)
    assert found == {b"bad"}  # not what is as frequent elsewhere, and not what stands in one window
    assert toxicity.marks([], [], 0) == set() and toxicity.marks(good, [], 0) == set()
    # without typical words whole windows are learned from, and nothing fails
    pairs = toxicity.dictionaries(good, [b" the cat sat "] * 30, 30)
    assert len(pairs) == len(toxicity.TOXIC_BYTES) and toxicity.dictionaries([b" a "], [b" b "], 1)


def test_toxicity_scores_equal_the_plain_definition(frame, spark):
    """Windows, both compressed sizes, counts above thresholds and the logistic, one window at a time."""
    rows = toxic_corpus(300)
    docs = frame([r[:3] for r in rows] + [(900, None, "s"), (901, "zzidiotqq " * 500, "s"), (902, "é 漢字 A-B", "s")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    m = toxicity.learn(docs, labels)
    small, large = (toxicity._compressor(d) for d in (m.ordinary, m.toxic + m.ordinary))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for r in docs.collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) >= 128 or c.isalnum() else " " for c in r.text or "")
        ws = text.encode().split()
        saved = []
        for i in range(0, len(ws), 12):
            w = b" " + b" ".join(ws[i : i + 12]) + b" "
            saved.append(len(small.compress(w)) - len(large.compress(w)))
        x = [1.0, math.log1p(len(saved)), min(10, max([0, *saved])) / 5] + [math.log1p(sum(d >= t for d in saved)) for t in toxicity.THRESHOLDS]
        for t, rate in zip(toxicity.THRESHOLDS, m.rates, strict=True):
            over = (sum(d >= t for d in saved) - rate * len(saved)) / math.sqrt(rate * len(saved) + 0.5)
            x.append(math.copysign(math.sqrt(abs(over)), over))
        plain = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, m.weights, strict=True))))))
        assert abs(got[r.doc_id] - plain) < 1e-9


def test_toxicity_without_labels(frame, spark):
    docs = frame(EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}


def test_labels_of_held_out_rows_do_not_matter(frame, spark):
    rows = toxic_corpus(300)
    docs = frame([r[:3] for r in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, a).collect()} == {(r.doc_id, r.score) for r in toxicity.toxicity(docs, b).collect()}


def test_toxicity_learns_from_whole_texts(frame, spark, monkeypatch):
    """Toxic passages at the end of labelled texts, behind more windows than a dictionary takes of each."""
    rng = random.Random(3)
    rows = [(i, f"{' '.join(rng.choice(['abcd', 'efgh', 'ijkl', 'mnop', 'dcba', 'hgfe']) for _ in range(240))} {t}", s, y) for i, t, s, y in toxic_corpus(400)]
    monkeypatch.setattr(toxicity, "TOXIC_WINDOWS", 15)
    docs = frame([r[:3] for r in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, _, y in rows}
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    text = " ".join(f"w{i}" for i in range(12000)).encode()
    ws = toxicity.drawn(text, b"k", 100)
    assert len(ws) == 100 and toxicity.windows(text).index(ws[-1]) > 900 and ws == toxicity.drawn(text, b"k", 100)


# -- language model


def lm_truth(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = [(i, [*(t or "").encode().translate(low).split(), b""]) for i, t, _ in rows]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter(w for i, ws in toks if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, not train(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks]


def lm_corpus():
    rng = random.Random(6)
    rows = list(EDGES)
    for i in range(100, 400):
        lang = rng.choice([["the", "of", "and", "to", "in"], ["der", "die", "und", "das", "ein"]])
        rows.append((i, " ".join(rng.choice(lang) if rng.random() < 0.8 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80))), "s"))
    return rows


def compare(got, rows):
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    b = sorted(lm_truth(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)


def test_lm_counts_and_held_out_gain(frame, nothing, monkeypatch):
    rows = lm_corpus()
    got = lm.score(frame(rows)).collect()
    compare(got, rows)
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the same with nearly all words through the join
    monkeypatch.setattr(lm, "KNOWN", 5)
    few = lm.score(frame(rows)).collect()
    compare(few, rows)
    assert lm.score(nothing).count() == 0


def test_lm_where_most_words_are_equally_frequent(frame, monkeypatch):
    """More words of the largest count than may be known: all but the outcomes go through the join."""
    monkeypatch.setattr(lm, "KNOWN", 500)
    rows = [(0, " ".join(f"w{i}" for i in range(3000)), "s"), (2, " ".join(f"v{i}" for i in range(700)), "s"), (5, "w1 w2 v3 new", "s"), (6, None, "s")]
    compare(lm.score(frame(rows)).collect(), rows)


def test_lm_on_one_long_text_of_distinct_words(frame):
    rows = [(0, " ".join(f"w{i}" for i in range(lm.KNOWN + 100)), "s"), (5, "w1 w2 x", "s")]
    compare(lm.score(frame(rows)).collect(), rows)


def test_large_scores_do_not_overflow():
    rng = np.random.default_rng(1)
    m = lm.train(rng.integers(0, lm.OUT, 3000), np.arange(3000) % 50, np.full(lm.OUT, 1 / lm.OUT))
    m.q *= 400
    got = m.log10(np.arange(100), np.arange(100))
    assert np.isfinite(got).all() and (got <= 1e-4).all()


def test_lm_scores_equal_the_plain_definition(frame, monkeypatch):
    """Each text's score, word by word: the outcome's share of all outcomes, and the word's share of its class."""
    rows, kept = lm_corpus(), {}
    first, last = lm.prepared, lm.scored
    monkeypatch.setattr(lm, "KNOWN", 300)
    monkeypatch.setattr(lm, "prepared", lambda docs, shared: kept.update(t=shared.value) or first(docs, shared))
    monkeypatch.setattr(lm, "scored", lambda df, shared: kept.update(m=shared.value) or last(df, shared))
    got = lm.score(frame(rows)).collect()
    t, m = kept["t"], kept["m"]
    c = Counter(w for i, text, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in lm.tokens((text or "").encode()))
    own = {w: int(t.outcome[k]) for w, k in t.index.items() if t.outcome[k] < lm.WORDS}
    of = lambda w: own.get(w, lm.WORDS + zlib.crc32(w.decode()[-2:].encode()) % lm.CLASSES)
    total, kinds = Counter(), Counter()
    for w, n in c.items():
        total[of(w)] += n
        kinds[of(w)] += 1

    def plain(text):
        out, ids = 0.0, [of(w) for w in lm.tokens(text)]
        for i, (w, k) in enumerate(zip(lm.tokens(text), ids, strict=True)):
            h = sum(m.r[ids[i - j] if i >= j else lm.OUT].astype(float) * m.w[j - 1] for j in range(1, lm.CONTEXT + 1))
            s = m.q.astype(float) @ h + m.b
            out += (s[k] - np.log(np.exp(s).sum())) / np.log(10)
            if k >= lm.WORDS:
                out += math.log10((c[w] + 0.5) / (total[k] + 0.5 * (kinds[k] + 1)))
        return out

    texts = {}
    for i, text, _ in rows:
        texts.setdefault(i, []).append((text or "").encode())
    for r in got:
        if r.n_tokens < 200:
            assert min(abs(r.score - plain(x)) for x in texts[r.doc_id]) < 1e-3 * r.n_tokens


def test_lm_is_a_distribution():
    rng = np.random.default_rng(1)
    ids, at = rng.integers(0, lm.OUT, 3000), np.arange(3000) % 50
    m = lm.train(ids, at, np.full(lm.OUT, 1 / lm.OUT))
    h = np.array([3, 9, 4, 0])
    total = sum(10 ** m.log10(np.r_[h, k], np.arange(5))[-1] for k in range(lm.OUT))
    assert abs(total - 1) < 1e-4


def test_noise_contrastive_training_learns_what_follows():
    rng = np.random.default_rng(1)
    ids = np.zeros(20000, np.int64)
    for i in range(1, len(ids)):
        ids[i] = (ids[i - 1] * 3 + 1) % 7 if rng.random() < 0.9 else rng.integers(0, 7)
    share = np.full(lm.OUT, 1e-6)
    share[:7] = np.bincount(ids, minlength=7)[:7] / len(ids)
    m = lm.train(ids, np.arange(len(ids)), share / share.sum())
    assert m.log10(ids[-3000:], np.arange(3000)).mean() > np.log10(1 / 7) + 0.25


def test_lm_learns_from_all_training_documents(frame, monkeypatch):
    """Where the driver's start has next to nothing, the rounds over all documents find what follows what."""
    rng, rows = random.Random(4), []
    for i in range(400):
        at, ws = rng.randrange(7), []
        for _ in range(60):
            at = (at * 3 + 1) % 7 if rng.random() < 0.9 else rng.randrange(7)
            ws.append(f"w{at}")
        rows.append((i, " ".join(ws), "s"))
    monkeypatch.setattr(lm, "FIT_TOKENS", 50)
    a = {r.doc_id: r for r in lm.score(frame(rows).repartition(7)).collect()}
    held = [r for r in a.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.25
    b = {r.doc_id: r for r in lm.score(frame(rows[::-1]).coalesce(1)).collect()}
    assert np.allclose([a[i].score for i in range(400)], [b[i].score for i in range(400)], rtol=1e-4)


def test_gradient_is_that_of_every_token():
    """Batches of texts sum to what each text gives on its own, and the differences to those of the objective."""
    rng = np.random.default_rng(2)
    sizes = np.array([1, 3, 700, 2])
    ids, at = rng.integers(0, lm.OUT, sizes.sum()), lm.places(sizes)
    share = rng.random(lm.OUT) + 0.1
    share /= share.sum()
    m = lm.train(rng.integers(0, lm.OUT, 3000), np.arange(3000) % 50, share)
    whole, ends = lm.gradient(m, ids, at, share), np.cumsum(sizes)
    parts = [lm.gradient(m, ids[z - n : z], at[z - n : z], share) for n, z in zip(sizes, ends, strict=True)]
    for k, x in enumerate(whole):
        assert np.allclose(x, sum(p[k] for p in parts), atol=1e-4)

    def objective():
        s = m.hidden(ids, at)[:, : lm.DIM].astype(float) @ m.q.T + m.b - np.log(lm.NOISE * share)
        chance = 1 / (1 + np.exp(-s))
        return np.log(chance[np.arange(len(ids)), ids]).sum() + (lm.NOISE * share * np.log(1 - chance)).sum()

    for p, g in zip((m.q, m.b, m.r, m.w), whole, strict=True):
        at_most = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at_most]
        p[at_most] = old + 1e-3
        up, high = objective(), p[at_most]
        p[at_most] = old - 1e-3
        slope = (up - objective()) / float(high - p[at_most])
        p[at_most] = old
        assert abs(slope - g[at_most]) < 0.02 * abs(slope) + 1e-2


def test_context_stays_in_its_text():
    rng = np.random.default_rng(4)
    m = lm.train(rng.integers(0, lm.OUT, 3000), np.arange(3000) % 50, np.full(lm.OUT, 1 / lm.OUT))
    sizes = np.array([2, 1, 5])
    ids, at = rng.integers(0, lm.OUT, 8), lm.places(sizes)
    h = m.hidden(ids, at)
    for i in range(8):
        before = [ids[i - j] if at[i] >= j else lm.OUT for j in range(1, lm.CONTEXT + 1)]
        assert np.allclose(h[i], [*sum(m.r[x] * w for x, w in zip(before, m.w, strict=True)), 1], atol=1e-5)


# -- pieces


def test_double_array_holds_its_keys():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abcdxyz") for _ in range(rng.randrange(1, 7))) for _ in range(800)})
    base, check, value = pieces.double_array(keys, list(range(len(keys))))

    def find(word):
        s = 0
        for c in word:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(k) == i for i, k in enumerate(keys)) and find(b"q") == -1 and find(b"") == -1


def toy():
    ps = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab▁é") if k else rng.choice("▁abé") for k in range(n)) for n in (1, 2, 3) for _ in range(60)})
    words = [w for w in words if "▁" not in w[1:].replace("▁" * (len(w) - 1), "")][:60]
    words = [w for w in words if not (w.strip("▁") and "▁" in w.lstrip("▁"))]
    return pieces.build(ps + [(w, -rng.random() * 5 - 1, "normal") for w in words], ranked=False)


def best_score(v, text):
    """Brute force over all ways to cut."""
    score = {v.pieces[i]: v.score[i] for i in range(256, len(v.pieces))}
    out = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
        parts, at = [], 0
        for e in ends:
            parts.append(text[at:e])
            at = e
        if all(p in score or len(p) == 1 for p in parts):
            out.append(sum(max(score.get(p, -1e9), v.byte_score if len(p) == 1 else -1e9) for p in parts))
    return max(out)


def test_viterbi_equals_brute_force():
    v, rng = toy(), random.Random(3)
    for _ in range(60):
        unit = (rng.choice(["", " ", "  "]) + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))).encode()[:11]
        ids = np.frombuffer(pieces.viterbi(v, [unit])[0], np.int32)
        got = sum(v.byte_score if i < 256 else v.score[i] for i in ids)
        assert abs(got - best_score(v, unit)) < 1e-9 and b"".join(v.pieces[i] for i in ids) == unit
        assert pieces._alone(v, unit).tobytes() == pieces.viterbi(v, [unit])[0]


def test_long_units_are_cut_where_no_piece_crosses():
    """Texts without spaces: parts make up the unit and its best path, and are not remembered."""
    v, rng = pieces.load(), random.Random(7)
    for n in (50, 900, 4000):
        unit = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.6 else rng.choice("theandx") for _ in range(n)).encode()
        parts = pieces.cuts(v, unit)
        assert b"".join(parts) == unit and all(parts)
        got = np.frombuffer(pieces.viterbi(v, [unit])[0], np.int32)
        score = lambda ids: sum(v.byte_score if i in set(v.byte_ids.tolist()) else v.score[i] for i in ids.tolist())
        assert b"".join(v.pieces[i] for i in got) == unit and abs(score(got) - score(pieces._alone(v, unit))) < 1e-6
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(500)).encode() for _ in range(50)]
    assert [pieces.decode(v, x) for x in pieces.encode(v, texts)] == texts
    assert all(len(u) <= pieces.BATCH_BYTES for u in pieces.remembered(v))


def test_query_decodes_to_the_whole_table(spark):
    """The query over the whole table: counts, byte pieces and digests against each text."""
    from graphloom.llm import queries

    v = pieces.load()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        whole = (text[r.doc_id] or "").encode()
        assert b"".join(v.pieces[i] for i in r.piece_ids)[1:] == whole and r.decoded_sha256 == hashlib.sha256(whole).hexdigest()
        assert r.n_pieces == len(r.piece_ids) and r.n_byte_pieces == sum(i in set(v.byte_ids.tolist()) for i in r.piece_ids)


def test_round_trip(frame, nothing):
    got = pieces.encoded(frame(EDGES)).collect()
    text = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in EDGES if t is not None}
    assert {r.decoded_sha256 for r in got if r.piece_ids is not None} == text
    assert sum(r.piece_ids is None for r in got) == sum(t is None for _, t, _ in EDGES)
    for r in got:
        assert r.n_pieces == len(r.piece_ids or [])
    v = pieces.load()
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice([" ", "  ", "a", "the", "▁", "\n", "é", "漢", "😀", "\x00", "\u00ad"]) for _ in range(rng.randrange(20)))
        assert pieces.decode(v, pieces.encode(v, [t.encode()])[0]).decode() == t
    assert pieces.encoded(nothing).count() == 0


# -- media


def test_media_is_lossless_and_equal_texts_agree(frame, nothing):
    rows = EDGES + [(50 + i, "ab" * i, "s") for i in (31, 32, 33)]
    got = media.audio(frame(rows)).collect()
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add((t or "").encode())
    seen = {}
    for r in got:
        ok = False
        for b in texts[r.doc_id]:
            p = b + bytes(-len(b) % 64 or (0 if b else 64))
            ok |= (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert ok
        assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len(got) == len(rows) and media.audio(nothing).count() == 0


def test_wav_is_a_wav_and_others_are_refused():
    import io
    import wave

    import pytest

    m = media.encode(bytes(range(64)))
    with wave.open(io.BytesIO(m)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(99)) == (1, 1, media.RATE, bytes(range(64)))
    for bad in (b"", b"RIFF", m[:50], m.replace(b"WAVE", b"WAVX")):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_features_see_tones_and_silence(spark):
    t = np.arange(32000) / media.RATE
    loud = np.where((t > 0.5) & (t < 1.2), 100 * np.sin(2 * np.pi * 1000 * t), 2 * np.sin(2 * np.pi * 300 * t))
    e = media.Extractor()
    mel, db = e.log_mel((loud + 128).astype(np.uint8).tobytes())
    (a, b), = e.segments(db)
    assert abs(a - 500) < 60 and abs(b - 1200) < 60
    band = int(mel[len(mel) // 2 - 5].argmax())
    assert 8 <= band <= 20
    # the resampler equals the plain definition
    x = np.random.default_rng(1).normal(size=300).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        bank = media.polyphase(up, down)
        h = bank[:, ::-1].T.ravel()
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        plain = np.convolve(wide, h)
        got = media.resample(x, bank, up, down)
        n = min(len(got), len(plain[::down]))
        assert np.allclose(got[:n], plain[::down][:n], atol=1e-4)


def test_summary_is_of_the_tensors(frame):
    """The query's feature against the plain definitions, for one to many tensors."""
    e = media.Extractor()
    for text in (b"", b"ab" * 40, b"hello world " * 3000, bytes(range(256)) * 200):
        mel, db = e.log_mel(media.payload(text))
        column, spans = media.tensor_column(mel)
        assert isinstance(column.type, pa.FixedShapeTensorType) and len(column) == -(-len(mel) // media.FRAMES) and spans[-1][1] == len(mel) * media.HOP_MS
        got = dict(x.split("=") for x in media.summary(column, spans, e.segments(db)).split(";"))
        assert got["mel"] == "/".join(str(int(x)) for x in np.rint(mel.mean(0, dtype=np.float64)))
        # hysteresis, frame by frame
        low, high = np.percentile(db, (10, 95))
        on, found = False, 0
        for x in db:
            was = on
            on = True if x >= low + media.START * (high - low) else False if x < low + media.END * (high - low) else on
            found += on and not was
        assert int(got["segments"]) == found


def test_tensors_have_a_fixed_shape(frame):
    m = media.store(frame([(1, "hello world " * 8000, "s"), (2, None, "s")]))
    t = media.features(m).toArrow()
    u = media.arrow_tensors(t)
    kind = u.schema.field("log_mel").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.FRAMES, media.MELS]
    assert u.column("log_mel").chunk(0).to_numpy_ndarray().shape == (t.num_rows, media.FRAMES, media.MELS)
    rows = t.to_pylist()
    assert all(r["start_ms"] < r["end_ms"] for r in rows) and sum(r["doc_id"] == 2 for r in rows) == 1
