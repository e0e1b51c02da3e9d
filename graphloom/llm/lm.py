"""Language-model scoring: corpus counts, and a log-bilinear model trained by noise-contrastive estimation.

Tokens are the lower-cased words and one end a text. Counts of all training tokens are summed over the corpus. The
neural model predicts an outcome from the CONTEXT outcomes before it: one of the WORDS most frequent tokens, or one of
CLASSES classes of the others (by the hash of a word's last two characters). Its score of an outcome is bilinear in
the outcome's vector and the weighted sum of the context's vectors; training by noise-contrastive estimation in numpy
needs no sum over outcomes, while scoring normalises over all of them by batched matrix products. A word of a class
then has its smoothed share of the class's counts, so the log probabilities are of a proper distribution over words.

Counts of the KNOWN most frequent words at most travel to every task; a document's other words are summed up and
joined with the counts table. The neural model learns from all training tokens: it starts from FIT_TOKENS tokens at
most of FIT_DOCS documents, in the order of the md5 of their ids, trained on the driver; where these are not all, it
goes on in STEPS rounds. Each round takes the training documents of one value of their ids' hash, so that every one is
in exactly one round; tasks sum the gradients of their documents' tokens, with the noise in expectation, and the
driver changes the model by the sum.

Nulls and edges: a null text counts as empty and has the end alone; a row whose doc_id is null is a training row;
without training tokens every base probability is 1; repeated rows are rows of their own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Scratch, binary, crc_mod, hashed, share_of, slices

WORDS, CLASSES, CONTEXT, DIM = 192, 64, 4, 15
KNOWN, FIT_DOCS, FIT_TOKENS, NOISE, PASSES = 200_000, 2000, 400_000, 12, 4
#: Rounds over the whole corpus, and the most that the first of them changes a parameter by.
STEPS, RATE = 16, 0.06
#: Distinct words that a task holds before it hands their counts on.
HOLD = 200_000
OUT = WORDS + CLASSES
#: Rows of the matrix products, and bytes of outcomes that are worked on at once; they stay in a core's cache.
BLOCK, AT_ONCE = 256, 1 << 15
#: The end token; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def class_of(word: bytes) -> int:
    """The class of a word by its last two characters, as class_column() has it."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % CLASSES


def class_column(word: str):
    return (F.crc32(F.expr(f"right({word}, 2)").cast("binary")) % CLASSES).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in binary(batch, "text"):
            c.update(tokens(text))
        if len(c) > HOLD:
            yield rows()
            c.clear()
    yield rows()


def counts(train: DataFrame) -> DataFrame:
    """(word, c) of all training tokens; each task sums its own before they are dealt out."""
    return train.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """Outcome vectors q and biases b, context vectors r and weights w; b alone is the unigram's log share."""

    q: np.ndarray
    b: np.ndarray
    r: np.ndarray
    w: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        """What every two neighbours in the context predict with together; made once a task."""
        two = [(self.r * self.w[j])[:, None] + (self.r * self.w[j + 1])[None] for j in range(0, CONTEXT, 2)]
        return [x.reshape(-1, DIM) for x in two]

    def log10(self, ids: np.ndarray, at: np.ndarray, pairs: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 P of each outcome given those before it in its text, normalised over all outcomes.

        ids are texts one after another and at is the place of each in its text.
        """
        h, q = self.hidden(ids, at, pairs), np.concatenate([self.q, self.b[:, None]], 1)
        hit = np.einsum("nd,nd->n", h, q[ids])
        # no exponent overflows where the largest possible score is small; otherwise the rows' own maxima are taken off
        far = len(ids) and float(np.linalg.norm(q, axis=1).max() * np.sqrt((h * h).sum(1).max())) > 60
        total, s = np.empty(len(ids), np.float32), np.empty((BLOCK, OUT), np.float32)
        for a in range(0, len(ids), BLOCK):
            z = min(len(ids), a + BLOCK)
            x = np.matmul(h[a:z], q.T, out=s[: z - a])
            if far:
                top = x.max(1)
                x -= top[:, None]
                hit[a:z] -= top
            np.exp(x, out=x)
            total[a:z] = x.sum(1)
        return (hit - np.log(total)) / np.log(10)

    def hidden(self, ids: np.ndarray, at: np.ndarray, pairs: list[np.ndarray] | None = None) -> np.ndarray:
        """What the context of each outcome predicts with, and a one for the biases."""
        real, x = padded(ids, at)
        out = np.ones((len(ids), DIM + 1), np.float32)
        out[:, :DIM] = 0
        for j, pair in enumerate(pairs or self.pairs()):
            out[:, :DIM] += pair[x[real - 2 * j - 1] * (OUT + 1) + x[real - 2 * j - 2]]
        return out


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the outcomes among all texts with CONTEXT empty places (OUT) before each, and what stands there."""
    texts = np.cumsum(at == 0)
    real = np.arange(len(ids)) + CONTEXT * texts
    x = np.full(len(ids) + CONTEXT * (int(texts[-1]) if len(ids) else 0), OUT)
    x[real] = ids
    return real, x


def train(ids: np.ndarray, at: np.ndarray, share: np.ndarray, seed: int = 3) -> Model:
    """A log-bilinear model by noise-contrastive estimation with share as the noise, by Adagrad on minibatches."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (OUT, DIM)).astype(np.float32), np.log(share).astype(np.float32), rng.normal(0, 0.1, (OUT + 1, DIM)).astype(np.float32), np.full((CONTEXT, DIM), 0.5, np.float32))
    if not len(ids):
        m.q[:] = 0
        return m
    grads = [np.full_like(x, 1e-2) for x in (m.q, m.b, m.r, m.w)]
    log_noise = np.log(NOISE * share).astype(np.float32)
    cdf = np.cumsum(share)
    size, rate = 1024, 0.15
    for step in range(PASSES):
        order = rng.permutation(len(ids))
        for a in range(0, len(ids), size):
            i = order[a : a + size]
            before = [np.where(at[i] >= j, ids[np.maximum(i - j, 0)], OUT) for j in range(1, CONTEXT + 1)]
            vec = [m.r[x] for x in before]
            h = sum(v * w for v, w in zip(vec, m.w, strict=True))
            k = np.minimum(np.searchsorted(cdf, rng.random(NOISE * 8) * cdf[-1]), OUT - 1)  # one noise sample for the batch, each weighs 1 / 8
            for target, weight, data in ((ids[i], 1.0, True), (k, 1 / 8, False)):
                q = m.q[target]
                s = (h * q).sum(1) + m.b[target] - log_noise[target] if data else h @ q.T + m.b[target] - log_noise[target]
                e = (np.float32(weight) * ((1 if data else 0) - 1 / (1 + np.exp(-s)))).astype(np.float32)
                dh = e[:, None] * q if data else e @ q
                dq = e[:, None] * h if data else e.T @ h
                db = e if data else e.sum(0)
                gq, gb = np.zeros_like(m.q), np.zeros_like(m.b)
                np.add.at(gq, target, dq)
                np.add.at(gb, target, db)
                gr, gw = np.zeros_like(m.r), np.zeros_like(m.w)
                for j, (x, v) in enumerate(zip(before, vec, strict=True)):
                    np.add.at(gr, x, dh * m.w[j])
                    gw[j] = (dh * v).sum(0)
                for p, g, acc in zip((m.q, m.b, m.r, m.w), (gq, gb, gr, gw), grads, strict=True):
                    g /= size
                    acc += g * g
                    p += np.float32(rate / (1 + step)) * g / np.sqrt(acc)
    return m


def gradient(m: Model, ids: np.ndarray, at: np.ndarray, share: np.ndarray, pairs: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Sums over the outcomes of the gradients of q, b, r and w; every outcome is noise with its expected number."""
    n, h, expected = len(ids), m.hidden(ids, at, pairs), (NOISE * share).astype(np.float32)
    # the chance to be data is (1 + tanh of half the score) / 2
    half = (np.concatenate([m.q, (m.b - np.log(expected))[:, None]], 1) / 2).T.copy()
    weight = expected[:, None] / 2
    pulls, pushed, miss = weight * m.q, np.zeros((OUT, DIM + 1)), np.empty(n, np.float32)
    dh, s = np.empty((n, DIM), np.float32), np.empty((BLOCK, OUT), np.float32)
    for a in range(0, n, BLOCK):
        z = min(n, a + BLOCK)
        t = np.matmul(h[a:z], half, out=s[: z - a])
        np.tanh(t, out=t)
        miss[a:z] = t[np.arange(z - a), ids[a:z]]
        np.matmul(t, pulls, out=dh[a:z])
        pushed += t.T @ h[a:z]
    miss = (1 - miss) / 2  # of each outcome, the chance not to be data
    columns = np.ascontiguousarray((h * miss[:, None]).T)
    g = np.stack([np.bincount(ids, c, OUT) for c in columns], 1) - weight * (pushed + h.sum(0, dtype=np.float64))
    dh += pulls.sum(0)
    np.subtract(miss[:, None] * m.q[ids], dh, out=dh)
    # what the vector at each place gets from the outcomes after it in its text
    real, x = padded(ids, at)
    wide = np.zeros((len(x) + CONTEXT, DIM), np.float32)
    wide[real] = dh
    back, own, gw = np.zeros((len(x), DIM), np.float32), m.r[x], np.empty(m.w.shape)
    for j, w in enumerate(m.w, 1):
        later = wide[j : j + len(x)]
        back += later * w
        gw[j - 1] = np.einsum("nd,nd->d", later, own, dtype=np.float64) if n else 0
    gr = np.stack([np.bincount(x, c, OUT + 1) for c in np.ascontiguousarray(back.T)], 1)
    return [g[:, :DIM], g[:, DIM], gr, gw]


class Steps:
    """Changes of a model by sums of gradients: moments by Adam, and a rate that falls to nothing."""

    def __init__(self, m: Model, rounds: int):
        self.m, self.rounds, self.n = m, rounds, 0
        self.mean, self.square = [[np.zeros(x.shape) for x in (m.q, m.b, m.r, m.w)] for _ in range(2)]

    def take(self, grads: list[np.ndarray]) -> None:
        """grads are means over the round's tokens."""
        rate = RATE * (1 - self.n / self.rounds)
        self.n += 1
        for p, g, a, b in zip((self.m.q, self.m.b, self.m.r, self.m.w), grads, self.mean, self.square, strict=True):
            a += 0.2 * (g - a)
            b += 0.05 * (g * g - b)
            p += (rate * a / (1 - 0.8**self.n) / (np.sqrt(b / (1 - 0.95**self.n)) + 1e-6)).astype(np.float32)


def places(sizes: np.ndarray) -> np.ndarray:
    """Place of each token in its text."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def learn_all(m: Model, prepared: DataFrame, share: np.ndarray, rounds: int) -> None:
    """Rounds over the outcomes of all training documents."""
    steps = Steps(m, rounds)
    for k in range(rounds):
        shared = prepared.sparkSession.sparkContext.broadcast(m)

        def fn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, n, m = None, 0, shared.value
            pairs = m.pairs()
            for batch in slices(batches, AT_ONCE):
                texts = binary(batch, "ids")
                ids = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
                g = gradient(m, ids, places(np.array([len(x) for x in texts], np.int64)), share, pairs)
                total = g if total is None else [x + y for x, y in zip(total, g, strict=True)]
                n += len(ids)
            if n:
                flat = np.concatenate([x.ravel() for x in total])
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "g"])

        parts = prepared.where((F.col("round") == k) & ~F.col("held_out")).select("ids").mapInArrow(fn, "n long, g binary").collect()
        shared.destroy()
        n = sum(r["n"] for r in parts)
        if not n:
            continue
        flat = np.sum([np.frombuffer(r["g"]) for r in sorted(parts, key=lambda r: bytes(r["g"]))], axis=0) / n
        shapes = [x.shape for x in (m.q, m.b, m.r, m.w)]
        cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
        steps.take([x.reshape(shape) for x, shape in zip(np.split(flat, cuts), shapes, strict=True)])


@dataclass
class Tables:
    """What every task needs: the known words with outcome, logs of base and of share in the class."""

    index: dict
    outcome: np.ndarray
    base: np.ndarray
    share: np.ndarray


def _outcomes(t: Tables, words: list[bytes], memory: dict) -> np.ndarray:
    """Place in the known words, or -1 - class."""
    get, n = t.index.get, len(words)
    place = np.fromiter(map(get, words, repeat(-1)), np.int64, n)
    for i in np.flatnonzero(place < 0).tolist():
        w = words[i]
        c = memory.get(w)
        if c is None:
            if len(memory) > HOLD:
                memory.clear()
            c = memory[w] = -1 - class_of(w)
        place[i] = c
    return place


PREPARED = "doc_id long, held_out boolean, round int, n_tokens long, n_known long, base double, inside double, ids binary, rest array<struct<word: string, n: long>>"


def prepared(docs: DataFrame, shared) -> DataFrame:
    """Sums over the known words of each text, the outcomes of its tokens as bytes, and its other words with their numbers."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, memory = shared.value, {}
        for batch in slices(batches, 2 << 20):
            texts = [tokens(x) for x in binary(batch, "text")]
            sizes = np.array([len(x) for x in texts], np.int64)
            starts = np.r_[0, np.cumsum(sizes)]
            words = [w for x in texts for w in x]
            place = _outcomes(t, words, memory)
            known = place >= 0
            ids = np.where(known, t.outcome[np.maximum(place, 0)], WORDS - 1 - place).astype(np.int64)
            flat = ids.astype(np.uint8).tobytes()
            inside = np.where(known, t.share[np.maximum(place, 0)], 0.0)
            base = np.where(known, t.base[np.maximum(place, 0)], 0.0)
            add = lambda x: np.add.reduceat(x, starts[:-1]) if len(sizes) else np.empty(0, x.dtype)
            rest, ends = Counter(), [0]
            flat_words, flat_n = [], []
            unknown = np.flatnonzero(~known)
            cut = np.searchsorted(unknown, starts)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rest = Counter(words[i] for i in unknown[a:b].tolist())
                flat_words += rest.keys()
                flat_n += rest.values()
                ends.append(len(flat_words))
            pair = pa.StructArray.from_arrays([pa.array(flat_words, pa.binary()).cast(pa.string()), pa.array(flat_n, pa.int64())], ["word", "n"])
            outcomes = pa.array([flat[a:z] for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())
            own = [batch.column(x) for x in ("doc_id", "held_out", "round")]
            cols = [*own, pa.array(sizes), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(inside)), outcomes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "round", "n_tokens", "n_known", "base", "inside", "ids", "rest"])

    return docs.select("doc_id", "held_out", "round", "text").mapInArrow(fn, PREPARED)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def scored(first: DataFrame, shared) -> DataFrame:
    """The model's log probability of each text's outcomes, with the words' shares in them."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pairs = m.pairs()
        for batch in slices(batches, AT_ONCE):
            texts = binary(batch, "ids")
            sizes = np.array([len(x) for x in texts], np.int64)
            got = m.log10(np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), places(sizes), pairs)
            score = np.add.reduceat(got, np.cumsum(sizes) - sizes) + batch.column("inside").to_numpy() if len(sizes) else np.empty(0)
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-1]), pa.array(score)], names)

    return first.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids").mapInArrow(fn, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
    rows = rows.withColumn("round", (F.conv(F.substring(hashed("doc_id"), 9, 7), 16, 10).cast("long") % STEPS).cast("int"))
    learn = rows.where("NOT held_out")
    table = tmp.save(counts(learn), "counts")
    total, kinds = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    per_class = lambda x: x.groupBy(class_column("word").alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))

    # the least count that at most KNOWN words reach; where the largest counts are too many, the outcomes alone are known
    floor = 1
    if kinds > KNOWN:
        floors = table.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(KNOWN).toPandas()
        fits = floors["c"][floors["k"].cumsum() <= KNOWN]
        floor = int(fits.min()) if len(fits) else int(floors["c"].max()) + 1
    first = table.orderBy(F.desc("c"), "word").limit(WORDS).union(table.where(F.col("word") == END.decode()))
    known = pd.concat([table.where(F.col("c") >= floor).toPandas(), first.toPandas()]).drop_duplicates("word").sort_values(["c", "word"], ascending=[False, True], kind="stable")
    words, c = [w.encode() for w in known["word"]], known["c"].to_numpy(np.float64)
    top = [w for w in words if w != END][: WORDS - 1]
    outcome_of = {END: 0} | {w: i + 1 for i, w in enumerate(top)}
    # classes hold what is no outcome of its own
    own = spark.createDataFrame([(w.decode(),) for w in outcome_of], "word string")
    by_class = {r["class"]: (r["n"], r["kinds"]) for r in per_class(table.join(F.broadcast(own), "word", "left_anti")).collect()}
    n_class = np.array([by_class.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64)
    k_class = np.array([by_class.get(k, (0, 0))[1] for k in range(CLASSES)], np.float64)
    outcome = np.array([outcome_of[w] if w in outcome_of else WORDS + class_of(w) for w in words] or [0], np.int64)
    inside = np.log10(np.r_[c, 0.0][: max(1, len(c))] + 0.5) - np.log10(n_class + 0.5 * (k_class + 1))[np.maximum(outcome - WORDS, 0)]
    noise = np.full(OUT, 0.5)
    np.add.at(noise, outcome[outcome < WORDS], c[outcome[: len(c)] < WORDS] if len(c) else 0.0)
    noise[WORDS:] += n_class
    low = np.log10(total + 0.5 * (kinds + 1))
    t = Tables({w: i for i, w in enumerate(words)}, outcome, np.log10(np.r_[c, 0.0][: max(1, len(c))] + 0.5) - low, np.where(outcome < WORDS, 0.0, inside))

    # the number of texts is that of ends; a threshold on the hash keeps what tasks send near FIT_DOCS in all
    n_train = int(c[words.index(END)]) if END in words else 0
    sample = learn.withColumn("h", hashed("doc_id")).where(F.substring("h", 1, 8) <= share_of(1.5 * FIT_DOCS, n_train))
    sample = sample.orderBy("h", "text").limit(FIT_DOCS).select("text").toPandas()["text"]
    ids, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, memory = FIT_TOKENS, {}
    for text in sample:
        ws = tokens((text or "").encode())
        if left <= 0:
            break
        left -= len(ws)
        place = _outcomes(t, ws, memory)
        ids.append(np.where(place >= 0, outcome[np.maximum(place, 0)], WORDS - 1 - place))
        at.append(np.arange(len(ws)))
    ids, at, noise = np.concatenate(ids), np.concatenate(at), noise / noise.sum()
    m = train(ids, at, noise)

    shared = spark.sparkContext.broadcast(t)
    first = tmp.save(prepared(rows, shared).sortWithinPartitions("round").withColumn("uid", F.monotonically_increasing_id()), "prepared")
    shared.destroy()
    if len(ids) < total:
        learn_all(m, first, noise, STEPS)
    neural = scored(first, spark.sparkContext.broadcast(m))
    rest = first.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n").join(table, "word", "left")
    sums = spark.createDataFrame([(k, float(np.log10(n_class[k] + 0.5 * (k_class[k] + 1)))) for k in range(CLASSES)], "class int, low_class double")
    rest = rest.withColumn("class", class_column("word")).join(F.broadcast(sums), "class")
    up = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = rest.groupBy("uid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (up - F.lit(float(low)))).alias("more_base"), F.sum(F.col("n") * (up - F.col("low_class"))).alias("more_score"))
    out = neural.join(rest, "uid", "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(b, F.lit(zero))).alias
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more", 0)("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base", "more_base", 0.0)("base_score"), plus("score", "more_score", 0.0)("score"))
