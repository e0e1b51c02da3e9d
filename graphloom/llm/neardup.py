"""MinHash near-duplicates with odd sketches.

Texts are lower-cased (A-Z), cut into words, and turned into sets of 64-bit hashes of five-word shingles. Banded
MinHash proposes groups; within a group, parity bitmaps of the MinHash samples (odd sketches) are compared by XOR
and population count, and only a spanning forest of what passes is kept. Its components hold every link, so the
full sets travel once to the task that confirms the links of a component.

Nulls and edges: a null or blank text has no shingles and is linked with nothing; a text of one to four words has
one shingle, the whole sequence; repeated texts are one class and linked; rows that repeat a doc_id count as one
document; a row whose doc_id is null is returned with a null component and is not linked; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Scratch, binary, grouped, runs, slices
from graphloom.llm.components import components
from graphloom.llm.exactdup import small

WORDS, BANDS, ROWS, BITS = 5, 40, 4, 512
SAMPLES = BANDS * ROWS
#: A bucket, or a candidate component, of more members than its block is compared in blocks that all hold the same
#: pivots; what the pivots don't tie to the rest meets the others in pairs of blocks of PAIR_BLOCK.
BUCKET_BLOCK, SET_BLOCK, PAIR_BLOCK, PIVOTS = 256, 48, 256, 8

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALT = _rng.integers(1, 1 << 62, SAMPLES, np.uint64)
_MASKS = [int(x) for x in _rng.integers(1, 1 << 60, PIVOTS)]


def most_flips(similarity: float, sigmas: float = 5.0) -> int:
    """Bits that two odd sketches of texts at the similarity may differ in: the mean and so many deviations."""
    flips = 2 * SAMPLES * (1 - similarity)
    keep = (1 - 2 / BITS) ** flips
    spread = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * keep
    own = math.sqrt(max(1.0, BITS / 4 * (1 - keep * keep)))
    return math.ceil(BITS / 2 * (1 - keep) + sigmas * math.hypot(spread, own / 2))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    ws = text.translate(LOWER).split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = max(1, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        s += h[j : j + n]
        s *= _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set: the least of each of SAMPLES permutations of 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[None, at : at + 2048] * _MUL[:, None] + _ADD[:, None]).min(1), out=out)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Odd sketches of MinHash samples, one row each: BITS // 64 words."""
    at = (((sig.astype(np.uint64) + _SALT) * _MIX) >> np.uint64(64 - 9)).astype(np.int64)
    flat = np.bincount((at + np.arange(len(sig))[:, None] * BITS).ravel(), minlength=len(sig) * BITS)
    return np.packbits((flat & 1).astype(np.uint8).reshape(len(sig), BITS), axis=1, bitorder="little").view(np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, x.shape[:2]).copy()
    for j in range(ROWS):
        h = (h ^ x[:, :, j]) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, sizes, sig = [], [], []
        for text in binary(batch, "text"):
            s = shingles(text)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"")
            sig.append(samples(s) if len(s) else np.zeros(SAMPLES, np.uint32))
        sig = np.array(sig, np.uint32).reshape(-1, SAMPLES)
        bands = pa.ListArray.from_arrays(np.arange(0, len(sig) * BANDS + 1, BANDS, dtype=np.int32), band_keys(sig).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), bands, pa.array([x.tobytes() for x in sketches(sig)], pa.binary())], ["doc_id", "key", "n_shingles", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("cc"), batch.column("size"), batch.column("sketch"), pa.array([shingles(x).tobytes() for x in binary(batch, "text")], pa.binary())], ["doc_id", "cc", "size", "sketch", "shingles"])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def _near(sk: np.ndarray, one: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(sk ^ one).sum(1) <= most


def screen(sk: np.ndarray, sizes: np.ndarray, most: int, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose sketches are near and whose sizes allow the similarity."""
    left, out = np.arange(len(sk)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            small, large = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            hit = _near(sk[left], sk[x], most) & (100 * small >= percent * large)
            found = left[hit].tolist()
            out += [(y, x) for y in found]
            todo += found
            left = left[~hit]
    return out


def _screen(most: int, percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, "unit"):
            doc = table.column("doc_id").to_numpy()
            size = table.column("n_shingles").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(doc), -1)
            n = np.diff(at)
            two = at[:-1][n == 2]
            ok = (np.bitwise_count(sk[two] ^ sk[two + 1]).sum(1) <= most) & (100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1]))
            u, v = [doc[two[ok]]], [doc[two[ok] + 1]]
            for k in np.flatnonzero(n > 2):
                a, b = at[k], at[k + 1]
                if found := screen(sk[a:b], size[a:b], most, percent):
                    f = np.array(found)
                    u.append(doc[a:b][f[:, 0]])
                    v.append(doc[a:b][f[:, 1]])
            edges = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    return fn


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' similarity is percent / 100 or more, in whole numbers."""
    small, large = sorted((a, b), key=len)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], sk: np.ndarray, start: np.ndarray, most: int, percent: int) -> np.ndarray:
    """Classes of the confirmed links, as roots; start holds classes known before."""
    f = Forest(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(start.tolist()):
        f.up[i] = first.setdefault(c, i)
    for i in range(1, len(sets)):
        flips = np.bitwise_count(sk[:i] ^ sk[i]).sum(1)
        near = np.flatnonzero(flips <= most)
        for j in near[np.argsort(flips[near], kind="stable")].tolist():
            a, b = f.root(i), f.root(j)
            if a != b and alike(sets[i], sets[j], percent):
                f.up[max(a, b)] = min(a, b)
    return f.roots()


def _link(most: int, percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, "unit"):
            doc, start = table.column("doc_id").to_numpy(), table.column("known").to_numpy()
            raw, sk = table.column("shingles"), np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(doc), -1)
            u, v = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
                    roots = link(sets, sk[a:b], start[a:b], most, percent)
                    u.append(doc[a:b])
                    v.append(doc[a:b][roots])
            u, v = (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return fn


def tied(rows: DataFrame, key: str, block: int, fn, payload: list[str], tmp: Scratch) -> DataFrame:
    """(u, v): the edges that fn finds in the groups of rows (key, size, doc_id, payload), with no pair of two classes left out.

    A group of a block or less is a unit of its own. The rows of a larger one are dealt into blocks that all hold the
    same pivots; those whose class is not the group's largest afterwards then meet all others in pairs of blocks, so
    what is copied grows with them and not with the square of the group.
    """
    large = rows.where(F.col("size") > block)
    parts = rows.where(F.col("size") <= block).select(F.col(key).alias("unit"), "doc_id", F.col("doc_id").alias("known"), *payload)
    blocks = F.ceil(F.col("size") / block).cast("long")
    pivots = large.groupBy(key, "size").agg(*[F.min(F.col("doc_id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"p{i}") for i, m in enumerate(_MASKS)])
    pivots = pivots.select(key, F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("doc_id"))
    copies = large.join(pivots, [key, "doc_id"]).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    own = large.join(pivots, [key, "doc_id"], "left_anti").withColumn("b", F.pmod(F.xxhash64("doc_id"), blocks))
    parts = parts.union(own.unionByName(copies).select(F.xxhash64(key, "b").alias("unit"), "doc_id", F.col("doc_id").alias("known"), *payload))
    links = tmp.save(grouped(parts, "unit", fn, "u long, v long"), "links")
    if large.isEmpty():
        return links

    known = tmp.save(components(links, tmp), "known")
    big = tmp.save(large.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("known", F.coalesce("component", "doc_id")).drop("component"), "big")
    per = big.groupBy(key, "known").agg(F.count("*").alias("n"))
    top = per.groupBy(key).agg(F.max(F.struct("n", "known")).alias("top")).select(key, "top.n", F.col("top.known").alias("top"))
    big = big.join(top, key).where("n < size").withColumn("rest", F.col("size") - F.col("n"))
    many = F.greatest(F.lit(1), F.ceil(F.col("rest") / PAIR_BLOCK)).cast("long")  # at least one, as filters are pushed below that of the rest
    zero, place = F.lit(0).cast("long"), lambda n: F.pmod(F.xxhash64("doc_id", F.lit(5)), n)
    others, whole = big.where("known <> top"), F.ceil(F.col("n") / PAIR_BLOCK).cast("long")
    each = F.sequence(zero, many - 1)
    sides = F.concat(F.transform(F.sequence(zero, whole - 1), lambda x: F.concat_ws(":", F.lit("t"), x)), F.transform(F.filter(each, lambda x: x > F.col("b")), lambda x: F.concat_ws(":", F.lit("r"), x)))
    loose = others.withColumn("b", place(many)).withColumn("side", F.explode(sides))
    wide = others.withColumn("c", place(many)).withColumn("b", F.explode(each)).where("c > b").withColumn("side", F.concat_ws(":", F.lit("r"), "c"))
    rest = big.where("known = top").withColumn("c", place(whole)).withColumn("b", F.explode(each)).withColumn("side", F.concat_ws(":", F.lit("t"), "c"))
    cols = [F.xxhash64(key, "b", "side").alias("unit"), "doc_id", "known", *payload]
    again = loose.select(*cols).union(wide.select(*cols)).union(rest.select(*cols))
    return tmp.save(links.union(grouped(again, "unit", fn, "u long, v long")), "links")


def near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per row of docs."""
    spark, percent = docs.sparkSession, round(100 * similarity)
    most, tmp = most_flips(similarity), Scratch(spark, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = tmp.save(texts.mapInArrow(_profile, "doc_id long, key binary, n_shingles long, bands array<long>, sketch binary"), "profiles")
    real = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = tmp.save(real.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    one = tmp.save(real.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).select("doc_id", "n_shingles", "bands", "sketch"), "unique")

    # buckets of two and more; of what they propose, a spanning forest of near sketches is kept
    rows = one.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = tmp.save(rows.join(sizes, "bucket"), "shared")
    met = tmp.save(small(shared).join(one.select("doc_id", "n_shingles", "sketch"), "doc_id"), "met")
    edges = tied(met, "bucket", BUCKET_BLOCK, _screen(most, percent), ["n_shingles", "sketch"], tmp)
    held = tmp.save(components(edges, tmp), "held")
    tmp.drop(shared, met)
    count = held.groupBy("component").agg(F.count("*").alias("size"))
    held = small(held).join(small(count), "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cc"), "size")
    held = tmp.save(small(held).join(one.select("doc_id", "sketch"), "doc_id").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("cc", "size", "sketch")]), "held")

    # the full sets of a component travel once, to where its links are confirmed
    sets = texts.join(small(held), "doc_id").mapInArrow(_sets, "doc_id long, cc long, size long, sketch binary, shingles binary")
    sets = tmp.save(sets, "sets")
    tmp.drop(one)
    links = tied(sets, "cc", SET_BLOCK, _link(most, percent), ["sketch", "shingles"], tmp)
    tmp.drop(sets)
    final = tmp.save(components(links, tmp), "final")
    named = tmp.save(classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id")), "named")
    tmp.drop(classes, final)
    # rows that repeat a doc_id with another text share its node, so a class may have the component of either
    out = every.join(named, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """The rows of docs less those that a document of smaller doc_id in their component stands for.

    Rows without a doc_id stay.
    """
    tmp = Scratch(docs.sparkSession, "neardup")
    lost = tmp.save(near_duplicates(docs, similarity).where("NOT kept").select(F.col("doc_id").alias("__lost")).distinct(), "lost")
    return docs.join(small(lost), docs["doc_id"].cast("long") == lost["__lost"], "left_anti")
