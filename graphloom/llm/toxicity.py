"""Toxicity by compression distance.

Texts are lower-cased (A-Z), other ASCII signs become spaces, and windows of twelve words are compressed twice: with
a zstandard dictionary of ordinary text, and with that one preceded by a dictionary trained on toxic text. The bytes
that the toxic dictionary saves are a window's distance. Dictionaries are trained again a few times: ordinary windows
that the toxic dictionary shortens go into the ordinary one, toxic windows that it does not shorten are left out. Of
a toxic window the toxic dictionary is trained on the words that are far more frequent in toxic windows than in others.
Thresholded counts of a document's windows are calibrated into a probability on labelled rows kept apart.

Learning reads at most FIT_TOXIC + FIT_ORDINARY labelled documents in the order of the md5 of their ids. Dictionaries
are trained on at most TOXIC_WINDOWS or ORDINARY_WINDOWS windows of each, drawn by hash from the whole text in tasks,
so the driver holds no texts; they are of at most ORDINARY_BYTES and TOXIC_BYTES, with HARD_BYTES of ordinary windows
that look toxic. The calibration takes whole texts, whose windows are counted in tasks, and so does scoring.

Nulls and edges: a null text counts as empty; empty texts have the score of a text without hits; labels of null
toxic or doc_id are ignored, and of repeated labels the larger counts; without labels of both kinds every score is
the share of toxic ones, or 0; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Scratch, binary, crc_mod, hashed, share_of, slices, trim

FIT_TOXIC, FIT_ORDINARY, TOXIC_WINDOWS, ORDINARY_WINDOWS = 2000, 5000, 200, 30
WINDOW, LEVEL, ROUNDS = 12, 12, 3
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 65536, 49152, (4096, 8192, 16384)
THRESHOLDS = (2, 3, 4, 5, 7)
#: What makes a word typical of toxic windows: so many times the ordinary rate, in one of so many toxic documents.
CONTRAST, RARE = 8, 250

#: ASCII letters (lower-cased) and digits stay, and so does all that is not ASCII.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


@dataclass
class Model:
    """Both dictionaries and the calibration; share is the score without a model, rates are of ordinary windows."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    share: float
    rates: np.ndarray

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)


def windows(text: bytes) -> list[bytes]:
    ws = text.translate(_PLAIN).split()
    return [b" %b " % b" ".join(ws[i : i + WINDOW]) for i in range(0, len(ws), WINDOW)]


def drawn(text: bytes, key: bytes, most: int) -> list[bytes]:
    """At most so many windows of the whole text, by the hash of the text's key and their place."""
    ws = windows(text)
    if len(ws) <= most:
        return ws
    seed = zlib.crc32(key)
    return [ws[i] for i in sorted(sorted(range(len(ws)), key=lambda i: zlib.crc32(b"%d" % i, seed))[:most])]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def distances(ws: list[bytes], ordinary, toxic) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    a, b = ordinary.compress, toxic.compress
    return np.fromiter((len(a(w)) - len(b(w)) for w in ws), np.int64, len(ws))


def summary(d: np.ndarray) -> np.ndarray:
    """What a text's distances are known by: their number, the largest, and the numbers above each threshold."""
    return np.array([len(d), d.max(initial=0), *((d[:, None] >= THRESHOLDS).sum(0) if len(d) else np.zeros(len(THRESHOLDS)))], float)


def features(s: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Counts of windows above each threshold, and how far each lies above what ordinary windows of that number give."""
    n, usual = s[2:], rates * s[0]
    over = (n - usual) / np.sqrt(usual + 0.5)
    return np.array([1.0, np.log1p(s[0]), min(10, s[1]) / 5, *np.log1p(n), *np.sign(over) * np.sqrt(np.abs(over))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _train(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too little text for a dictionary: the text itself is one
        return b"".join(samples)[:size]


def marks(good: list[bytes], bad: list[bytes], docs: int) -> set[bytes]:
    """Words that toxic windows have at least CONTRAST times as often as ordinary ones, in one of RARE toxic documents or more."""
    a, b = (Counter(w for x in ws for w in set(x.split())) for ws in (bad, good))
    least, scale = max(2, docs / RARE), (len(good) + 1) / (len(bad) + 1)
    return {w for w, n in a.items() if n >= least and (n + 0.5) * scale >= CONTRAST * (b[w] + 0.5)}


def dictionaries(good: list[bytes], bad: list[bytes], docs: int) -> list[tuple[bytes, bytes]]:
    """Pairs of an ordinary and a toxic dictionary, one for each of TOXIC_BYTES, from the windows of so many toxic documents."""
    rng = np.random.default_rng(5)
    good = [good[i] for i in rng.permutation(len(good))]
    base, words = _train(ORDINARY_BYTES, good), marks(good, bad, docs)
    # what is typical of toxic windows, without the ordinary words around it
    told = {w: b" %b " % b" ".join(x for x in w.split() if x in words) for w in bad}
    bad = [w for w in bad if told[w].strip()] or bad

    def attempt(size: int) -> tuple[bytes, bytes]:
        ordinary, extra = base, _train(size, [told[w] for w in bad])
        for _ in range(ROUNDS):
            a, b = _compressor(ordinary or b" "), _compressor((extra + ordinary) or b" ")
            hard = [w for w, d in zip(good, distances(good, a, b), strict=True) if d >= 3]
            keep = [w for w, d in zip(bad, distances(bad, a, b), strict=True) if d >= 3]
            ordinary = b"".join(hard)[:HARD_BYTES] + ordinary
            extra = _train(size, [told[w] for w in keep]) or extra
        return ordinary or b" ", extra

    with ThreadPoolExecutor(len(TOXIC_BYTES)) as pool:  # compression frees the interpreter
        return list(pool.map(attempt, TOXIC_BYTES))


def calibrated(pair: tuple[bytes, bytes], far: np.ndarray, y: np.ndarray, share: float, prior: float) -> tuple[float, Model]:
    """The loss and the model of a pair of dictionaries, by the summaries of rows; prior is the share of toxic rows where they come from."""
    plain = far[y == 0]
    rates = (plain[:, 2:].sum(0) + 0.5) / (plain[:, 0].sum() + 2)
    x = np.array([features(d, rates) for d in far])
    w = _logistic(x, y)
    if prior and 0 < prior < 1:
        odds = lambda q: np.log(q / (1 - q))
        w[0] += odds(prior) - odds(y.mean())
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    weight = np.where(y > 0, (prior or y.mean()) / y.mean(), (1 - (prior or y.mean())) / (1 - y.mean()))
    return -np.average(np.log(np.where(y > 0, p, 1 - p) + 1e-12), weights=weight), Model(*pair, w, share, rates)


def summaries(rows: DataFrame, pairs: list[tuple[bytes, bytes]]) -> DataFrame:
    """(__h, __toxic, far) of whole texts: their summaries under each pair of dictionaries, one after another."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(_compressor(a), _compressor(b + a)) for a, b in pairs]
        for batch in slices(batches):
            out = []
            for text in binary(batch, "__text"):
                ws = windows(text)
                out.append(np.concatenate([summary(distances(ws, *x)) for x in both]))
            yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("__toxic").cast(pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["__h", "__toxic", "far"])

    return rows.select("__h", "__toxic", "__text").mapInArrow(fn, "__h string, __toxic long, far array<double>")


def sampled(rows: DataFrame) -> DataFrame:
    """(__h, __toxic, ws) of texts: the windows that dictionaries are trained on."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            most = [TOXIC_WINDOWS if x == 1 else ORDINARY_WINDOWS for x in batch.column("__toxic").to_pylist()]
            ws = [drawn(t, k, n) for t, k, n in zip(binary(batch, "__text"), binary(batch, "__h"), most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("__toxic").cast(pa.int64()), pa.array(ws, pa.list_(pa.binary()))], ["__h", "__toxic", "ws"])

    return rows.select("__h", "__toxic", "__text").mapInArrow(fn, "__h string, __toxic long, ws array<binary>")


def scores(model: Model, texts: list[bytes], pair=None) -> np.ndarray:
    if not len(model.weights):
        return np.full(len(texts), model.share)
    a, b = pair or model.compressors()
    x = np.array([features(summary(distances(windows(t), a, b)), model.rates) for t in texts]).reshape(len(texts), -1)
    return 1 / (1 + np.exp(-np.clip((x * model.weights).sum(1), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model to a bounded sample of the labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    known = known.where(crc_mod("__id", 5) != 0).withColumn("__h", hashed("__id"))
    n = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    # thresholds on the hash keep what tasks send near the bounds in all
    few = lambda kind, most: known.where(F.col("__toxic") == kind).where(F.substring("__h", 1, 8) <= share_of(1.2 * most, n.get(kind, 0))).orderBy("__h").limit(most)
    picked = few(1, FIT_TOXIC).union(few(0, FIT_ORDINARY))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(picked), "__id")
    # of rows that repeat a doc_id the least text counts, so that the order of rows is no matter
    rows = rows.groupBy("__id", "__toxic", "__h").agg(F.min("__text").alias("__text"))
    rows = Scratch(docs.sparkSession, "toxicity").save(rows.withColumn("__apart", F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % 3 == 0), "sample")
    kinds = {(r["__apart"], r["__toxic"]): r["n"] for r in rows.groupBy("__apart", (F.col("__toxic") == 1).alias("__toxic")).agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    share = sum(k for (_, bad), k in kinds.items() if bad) / max(1, total)
    if not 0 < share < 1:
        return Model(b"", b"", np.zeros(0), share, np.zeros(0))
    # dictionaries from the rows that are not apart, the calibration from those that are, if both have both kinds
    two = len(kinds) == 4
    got = sampled(rows.where(~F.col("__apart")) if two else rows).toPandas().sort_values("__h")
    good, bad = ([bytes(w) for ws in got["ws"][(got["__toxic"] == 1) == kind] for w in ws] for kind in (False, True))
    del got
    pairs = dictionaries(good, bad, sum(n for (apart, toxic), n in kinds.items() if toxic and not (two and apart)))
    del good, bad
    trim()
    held = summaries(rows.where("__apart") if two else rows, pairs).toPandas().sort_values("__h")
    y = (held["__toxic"] == 1).to_numpy(float)
    far = np.array(held["far"].tolist()).reshape(len(held), len(pairs), -1)
    prior = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    return min((calibrated(pair, far[:, i], y, share, prior) for i, pair in enumerate(pairs)), key=lambda m: m[0])[1]


def score_column(model: Model):
    """A column function: the score of a text."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors() if len(model.weights) else None
        for part in parts:
            yield pd.Series(scores(model, [(t or "").encode() for t in part], pair))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = learn(docs, labels)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if len(model.weights) else None
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(model, binary(batch, "text"), pair))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic."""
    return docs.where(score_column(learn(docs, labels))(F.col("text")) < 0.5)
