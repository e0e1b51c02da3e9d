"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The trie runs over bytes; the whitespace marker is kept as a space in it, so a literal marker character in a text is
not mistaken for a space and decodes to itself. Bytes that no piece covers become byte pieces. No piece has a space
behind another character, nor a line feed, so texts are cut into units there (spaces and the word behind them) and a
unit's best path is found once; many units go through the trie together. Longer units, such as texts without spaces,
are cut again where no piece crosses. What a process remembers is REMEMBER units of BATCH_BYTES bytes at most.

A vocabulary of merges has ranks in place of log scores; piece r of them then weighs as Zipf's law has it,
-log(r + 1) less the log of the sum, which keeps the order. Of equally good paths the one whose last piece is longest
wins, and so on backwards. Decoding joins the pieces' bytes and takes off the leading space that encoding puts first,
so every text comes back exactly.

Nulls and edges: a null text has null ids; an empty one has none; repeated rows are encoded one by one; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units remembered by a process; units up to BATCH_BYTES long are searched together.
REMEMBER, BATCH_BYTES, BATCH_ROWS = 200_000, 40, 4096


@dataclass
class Vocabulary:
    """Pieces as bytes by id, the trie, log scores, and byte pieces."""

    pieces: list[bytes]
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    byte_score: float
    longest: int


#: The units of the last vocabulary that this process encoded with; one only, as workers outlive queries.
_last: list = [None, {}]


def remembered(v: Vocabulary) -> dict[bytes, bytes]:
    if _last[0] is not v:
        _last[:] = v, {}
    return _last[1]


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of each state; the child of s by byte c is base[s] + c where check of that is s.

    State 0 is the root; check -1 marks a free place, and value -1 no key.
    """
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in zip(keys, values, strict=True):
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = nxt
        value[at] = v
    used, place, todo = bytearray(1024), [(0, 0, -1)], [(0, 0)]
    used[0] = 1
    bases: dict[int, int] = {}
    free, dense = 257, 257  # the first free place, behind what a small base cannot reach, and where nodes with several children begin to look
    while todo:
        node, state = todo.pop()
        kids = sorted(children[node])
        if not kids:
            continue
        while used[free]:
            free += 1
        b, tries = max(1, (free if len(kids) == 1 else max(free, dense)) - kids[0]), 0
        while True:
            if b + 512 > len(used):
                used.extend(bytes(len(used)))
            if not any(used[b + c] for c in kids):
                break
            b, tries = b + 1, tries + 1
        if tries > 200:
            dense = b  # a region this full is left to nodes with one child
        bases[state] = b
        for c in kids:
            used[b + c] = 1
            place.append((b + c, children[node][c], state))
            todo.append((children[node][c], b + c))
    size = len(used)
    base, check, out = np.full(size, size - 256, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for state, node, parent in place:
        check[state], out[state] = parent, value[node]
    for state, b in bases.items():
        base[state] = b
    return base, check, out


def build(pieces: list[tuple[str, float, str]], ranked: bool) -> Vocabulary:
    """A vocabulary of (piece, score, kind) by id; kind is normal, byte or control. ranked: scores are minus ranks."""
    text = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
    score = np.array([s for _, s, _ in pieces], np.float64)
    normal = np.array([k == "normal" for *_, k in pieces])
    if any(re.search(rb"[^ ] |\n", text[i]) for i in np.flatnonzero(normal)):
        raise ValueError("a piece has a space behind another character, or a line feed")
    if ranked:
        order = np.flatnonzero(normal)
        order = order[np.argsort(-score[order], kind="stable")]
        zipf = -np.log(np.arange(1, len(order) + 1))
        score[order] = zipf - np.log(np.exp(zipf).sum())
    ids = np.flatnonzero(normal & (np.array([len(t) for t in text]) > 0))
    base, check, piece = double_array([text[i] for i in ids], ids.tolist())
    byte_ids = np.full(256, -1, np.int64)
    for i, (p, _, k) in enumerate(pieces):
        if k == "byte":
            byte_ids[int(p[3:5], 16)] = i
            text[i] = bytes([int(p[3:5], 16)])
        elif k == "control":
            text[i] = b""
    if (byte_ids < 0).any():
        raise ValueError("a byte has no piece")
    return Vocabulary(text, base, check, piece, score, byte_ids, float(score[ids].min()) - 10, max(len(text[i]) for i in ids))


def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; what it gives is as large as the vocabulary."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) else "normal"
    rows = [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.vocab_size())]
    seen = sorted(-s for _, s, k in rows if k == "normal" and s > -1e8)
    return build(rows, ranked=seen[-1] > 1000 and all(float(s).is_integer() for s in seen))


def _alone(v: Vocabulary, unit: bytes) -> np.ndarray:
    """The best path of one unit of any length."""
    n, base, check, piece, score = len(unit), v.base, v.check, v.piece, v.score
    best = [0.0] + [-np.inf] * n
    back = [0] * (n + 1)
    size = [0] * (n + 1)
    for p in range(n):
        here, state = best[p], 0
        for q in range(p, min(n, p + v.longest)):
            t = base[state] + unit[q]
            if check[t] != state:
                break
            state = t
            if piece[t] >= 0 and here + score[piece[t]] > best[q + 1]:
                best[q + 1], back[q + 1], size[q + 1] = here + score[piece[t]], piece[t], q + 1 - p
        if here + v.byte_score > best[p + 1]:
            best[p + 1], back[p + 1], size[p + 1] = here + v.byte_score, v.byte_ids[unit[p]], 1
    out, at = [], n
    while at:
        out.append(back[at])
        at -= size[at]
    return np.array(out[::-1], np.int32)


def cuts(v: Vocabulary, unit: bytes) -> list[bytes]:
    """The unit in parts whose ends no piece crosses, so that their best paths make up the unit's."""
    text, n = np.frombuffer(unit, np.uint8), len(unit)
    ends = np.arange(1, n + 1)
    for a in range(0, n, 1 << 16):
        at = np.arange(a, min(n, a + (1 << 16)))
        live, state = at, np.zeros(len(at), np.int32)
        for step in range(v.longest):
            t = v.base[state] + text[live + step]
            ok = v.check[t] == state
            live, state = live[ok], t[ok]
            hit = v.piece[state] >= 0
            ends[live[hit]] = live[hit] + step + 1
            ok = live + step + 1 < n
            live, state = live[ok], state[ok]
            if not len(live):
                break
    free = [*np.flatnonzero(np.maximum.accumulate(ends)[:-1] == np.arange(1, n)) + 1, n] if n else []
    return [unit[a:z] for a, z in zip([0, *free[:-1]], free, strict=True)]


def viterbi(v: Vocabulary, units: list[bytes]) -> list[bytes]:
    """The best path of each unit, as bytes of int32 ids; units of up to BATCH_BYTES bytes go together."""
    out: list[bytes] = [b""] * len(units)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    short = [i for i in order if len(units[i]) <= BATCH_BYTES]
    for i in order[len(short) :]:
        parts = cuts(v, units[i])
        if len(parts) == 1:
            out[i] = _alone(v, units[i]).tobytes()
            continue
        known = list(dict.fromkeys(parts))
        ids = dict(zip(known, viterbi(v, known), strict=True))
        out[i] = b"".join(map(ids.__getitem__, parts))
    for a in range(0, len(short), BATCH_ROWS):
        rows = short[a : a + BATCH_ROWS]
        size = np.array([len(units[i]) for i in rows])
        wide = int(size[-1])
        if not wide:
            continue
        text = np.frombuffer(b"".join(units[i].ljust(wide, b"\0") for i in rows), np.uint8).reshape(-1, wide)
        m = len(rows)
        best, back, step = np.full((m, wide + 1), -np.inf), np.zeros((m, wide + 1), np.int32), np.zeros((m, wide + 1), np.int32)
        best[:, 0] = 0
        for p in range(wide):
            live = np.flatnonzero(size > p)
            state = np.zeros(len(live), np.int32)
            first = text[live, p]
            for q in range(p, min(wide, p + v.longest)):
                t = v.base[state] + text[live, q]
                ok = (v.check[t] == state) & (size[live] > q)
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                end = v.piece[state]
                at = np.flatnonzero(end >= 0)
                r, e = live[at], end[at]
                s = best[r, p] + v.score[e]
                up = s > best[r, q + 1]
                r, e = r[up], e[up]
                best[r, q + 1], back[r, q + 1], step[r, q + 1] = s[up], e, q + 1 - p
            live = np.flatnonzero(size > p)
            s = best[live, p] + v.byte_score
            up = s > best[live, p + 1]
            r = live[up]
            best[r, p + 1], back[r, p + 1], step[r, p + 1] = s[up], v.byte_ids[first[up]], 1
        ids, n, at = np.zeros((m, wide), np.int32), np.zeros(m, np.int64), size.copy()
        live = np.flatnonzero(at > 0)
        while len(live):
            n[live] += 1
            ids[live, wide - n[live]] = back[live, at[live]]
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        for k, i in enumerate(rows):
            out[i] = ids[k, wide - n[k] :].tobytes()
    return out


#: Spaces and what follows them up to a space or line feed; or spaces alone, or a line feed.
_UNIT = re.compile(rb" *[^ \n]+| +|\n")


def encode(v: Vocabulary, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text."""
    units, memory = [_UNIT.findall(b" " + t) if t else [] for t in texts], remembered(v)
    new = {u for x in units for u in x if u not in memory}
    if len(memory) + len(new) > REMEMBER:
        memory.clear()
        new = {u for x in units for u in x}
    new = list(new)
    memory.update(zip(new, viterbi(v, new), strict=True))
    get = memory.__getitem__
    out = [np.frombuffer(b"".join(map(get, x)), np.int32) for x in units]
    for u in new:
        if len(u) > BATCH_BYTES:
            del memory[u]
    return out


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids; control pieces are nothing."""
    return b"".join(map(v.pieces.__getitem__, ids.tolist()))[1:]


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, piece_ids array<int>, decoded_sha256 string"


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, path: str = MODEL) -> DataFrame:
    """Ids of each text, and the sha-256 of the text that they decode to, one row per row of docs."""
    v = vocabulary or load(path)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids] = True
        for batch in slices(batches, 2 << 20):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            ids = encode(v, [x or b"" for x in raw])
            null = np.array([x is None for x in raw], bool)
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[null, False]), pa.array(flat))
            fallback = [int(is_byte[x].sum()) for x in ids]
            sha = [None if n else hashlib.sha256(decode(v, x)).hexdigest() for x, n in zip(ids, null, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(fallback, pa.int64()), lists, pa.array(sha, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, SCHEMA)
