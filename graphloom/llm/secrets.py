"""Secret scans by grammar inference.

Labelled credentials are read into prefix trees over character classes; states whose outgoing shares are
statistically compatible (Hoeffding's bound) are merged, red-blue order, into one probabilistic automaton a format.
The labels are the base patterns' own matches in the corpus, whose values are learned kind by kind; public formats
that no base pattern names are spelled out from their definitions. Every candidate token is scored by its log
likelihood under each format against an automaton of ordinary tokens, which are the corpus's other candidates and
spelled-out ones. Where the whole doesn't pass so are its parts behind signs (NAME=value, paths). Those above a
threshold set on credentials and ordinary tokens kept apart are spans of kind `format`. The base patterns always count.

Learning reads every text once and keeps at most LEARN values of LEARN_CHARS characters or fewer of each kind, in the
order of their md5; a kind with fewer than LEAST values has no automaton. Scoring has no bounds.

Nulls and edges: a null text counts as empty and has no spans, the sha-256 of nothing and an empty list; spans are
in code points, end exclusive; repeated rows are scanned one by one; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, slices

#: The base kinds in their order, with their patterns and the least length of the group that counts.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The same matches as hex's: a run of fewer characters fails whole.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: What may hold an assignment; a text without any of them has none.
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: Candidates of the method: whole runs of 16 characters or more; those with a digit and a letter are scored.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Public formats: a literal start, an alphabet and the lengths of the rest.
FORMATS = {
    "aws-access": ("AKIA", _UP + "234567", (16,)), "github": ("ghp_", _UP + _LOW + _DIG, (36,)), "slack": ("xoxb-", _DIG + "-" + _UP + _LOW, (40, 50)),
    "google": ("AIza", _UP + _LOW + _DIG + "-_", (35,)), "stripe": ("sk_live_", _UP + _LOW + _DIG, (24, 32)), "npm": ("npm_", _UP + _LOW + _DIG, (36,)),
    "jwt": ("eyJ", _UP + _LOW + _DIG + "-_", (60, 120)), "base64": ("", _UP + _LOW + _DIG + "+/", (40, 44)), "hex": ("", _DIG + "abcdef", (32, 40, 64)), "upper hex": ("", _DIG + "ABCDEF", (32, 40, 64)),
}
SAMPLES, ALPHA, MARGIN = 300, 0.05, 4.0
#: What is learned from the corpus: values of a kind and ordinary tokens at most, their longest, and a kind's fewest.
LEARN, LEARN_CHARS, LEAST = 400, 400, 20


def symbols(token: str) -> str:
    """Character classes; signs stand for themselves."""
    return token.translate(_CLASS)


_CLASS = {ord(c): "h" if c in "abcdef" else "l" for c in _LOW} | {ord(c): "H" if c in "ABCDEF" else "U" for c in _UP} | {ord(c): "d" for c in _DIG}


def credentials(name: str, n: int, rng: np.random.Generator) -> list[str]:
    """Labelled credentials of a format."""
    start, alphabet, lengths = FORMATS[name]
    return [start + "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.choice(lengths))) for _ in range(n)]


def ordinary(n: int, rng: np.random.Generator) -> list[str]:
    """Tokens that look like no credential: words, numbers, dates, addresses, paths, names."""
    word = lambda k=8: "".join(_LOW[i] for i in rng.integers(0, 26, rng.integers(2, k)))
    num = lambda k=6: str(rng.integers(0, 10**k))
    kinds = (
        lambda: "".join(word(6) for _ in range(rng.integers(3, 6))) + num(2), lambda: "-".join(word() for _ in range(4)) + num(3), lambda: "_".join(word() for _ in range(4)) + num(2),
        lambda: "/".join([word(), word(), num(4), word()]) + ".html", lambda: ".".join(num(3) for _ in range(4)) + "/" + word(), lambda: f"www.{word()}{word()}.example.com/{num(3)}",
        lambda: f"{num(4)}-{num(2)}-{num(2)}T{num(2)}", lambda: word().capitalize() + word().capitalize() + word().capitalize() + num(3), lambda: "=".join([word(), num(9)]) + word(), lambda: word(9).upper() + "_" + word(9).upper() + "_" + num(4),
    )
    return [kinds[i]() for i in rng.integers(0, len(kinds), n)]


class Automaton:
    """A probabilistic automaton: for each state, counts of symbols with their targets, and of ends."""

    def __init__(self, samples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in samples:
            at = 0
            for c in s:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][c]
            self.count[at][""] += 1
        self._merge()
        self.total = [sum(c.values()) for c in self.count]

    def _differ(self, a: int, b: int, c: str) -> bool:
        n, m = sum(self.count[a].values()), sum(self.count[b].values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(self.count[a][c] / n - self.count[b][c] / m) > bound

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            if any(self._differ(a, b, c) for c in self.count[a].keys() | self.count[b].keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in red]
            if not blue:
                break
            r, c, t = min(blue, key=lambda x: (-sum(self.count[x[2]].values()), x))
            for q in red:
                if self._alike(q, t):
                    self.next[r][c] = q
                    self._fold(q, t)
                    break
            else:
                red.append(t)

    def score(self, s: str) -> float:
        """Log likelihood with a little for what was not seen."""
        at, out = 0, 0.0
        for i, c in enumerate(s):
            n = self.count[at][c]
            out += math.log((n + 0.02) / (self.total[at] + 0.4))
            if c not in self.next[at]:
                return out - 3.0 * (len(s) - i)
            at = self.next[at][c]
        return out + math.log((self.count[at][""] + 0.02) / (self.total[at] + 0.4))


class Model(NamedTuple):
    """The formats' automata, that of ordinary tokens, and the threshold."""

    formats: list[Automaton]
    plain: Automaton
    limit: float


def fit(labelled: dict[int, list[str]] | None = None, others: list[str] | None = None) -> Model:
    """A model of the public formats, with what the corpus labels by kind and its ordinary tokens; fixed seeds."""
    rng = np.random.default_rng(11)
    known = [credentials(name, SAMPLES, rng) for name in FORMATS]
    plain, fresh = ordinary(4 * SAMPLES, rng), ordinary(2 * SAMPLES, rng)
    apart = [x for name in FORMATS for x in credentials(name, 60, rng)]
    for values in (labelled or {}).values():
        if len(values) >= LEAST:
            known.append([x for i, x in enumerate(values) if i % 5])
            apart += values[::5]
    formats = [Automaton([symbols(x) for x in xs]) for xs in known]
    m = Model(formats, Automaton([symbols(x) for x in plain]), MARGIN)
    # tokens that have a format's look are no example of ordinary ones
    more = [x for x in others or () if likelihood(x, m) < MARGIN]
    if more:
        m = Model(formats, Automaton([symbols(x) for x in plain + [x for i, x in enumerate(more) if i % 5]]), MARGIN)
    low = max(likelihood(x, m) for x in fresh + more[::5])
    high = sorted(likelihood(x, m) for x in apart)
    return Model(formats, m.plain, max(MARGIN, min(low + 1, high[len(high) // 100])))


@lru_cache(1)
def model() -> Model:
    """The model of the public formats alone; learned in a second."""
    return fit()


def likelihood(token: str, m: Model | None = None) -> float:
    """Best log likelihood ratio of a format to ordinary text."""
    m, s = m or model(), symbols(token)
    return max(f.score(s) for f in m.formats) - m.plain.score(s)


def matches(text: str) -> Iterator[tuple[int, re.Match]]:
    """(kind, match) of the base kinds; the match's last group, or the whole, is the value."""
    for k, (name, pattern, group, least) in enumerate(BASE):
        if name == "assign" and not _HINT.search(text):
            continue
        pattern = _LONG_HEX if name == "hex" else pattern
        yield from ((k, m) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    return sorted((m.start(), k, m.end()) for k, m in matches(text))


#: Parts of a candidate: first those behind a '=' (with the padding at their ends), then those between '/' and '.'.
_PARTS = re.compile(r"[^=]+=*"), re.compile(r"[^/.]+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


class Taken:
    """Places that spans cover."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start, self.end = [], []
        for a, z in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], z)
            else:
                self.start.append(a)
                self.end.append(z)

    def meets(self, a: int, z: int) -> bool:
        i = bisect_right(self.end, a)
        return i < len(self.start) and self.start[i] < z


def _inside(text: str, a: int, z: int, taken: Taken, m: Model, level: int = 0, tried: bool = False) -> Iterator[tuple[int, int]]:
    """text[a:z] if it passes, otherwise its parts that do."""
    token = text[a:z]
    if z - a < 16 or not (_DIGIT.search(token) and _LETTER.search(token)):
        return
    if not tried and not taken.meets(a, z) and likelihood(token, m) >= m.limit:
        yield a, z
    elif level < len(_PARTS):
        for part in _PARTS[level].finditer(text, a, z):
            yield from _inside(text, *part.span(), taken, m, level + 1, part.span() == (a, z))


def scan(text: str, m: Model | None = None) -> tuple[list, list]:
    """Base spans, and the method's that overlap none of them; (start, kind, end)."""
    base, m = base_spans(text), m or model()
    taken = Taken([(a, b) for a, _, b in base])
    more = []
    for c in _CANDIDATE.finditer(text):
        more += [(a, len(BASE), b) for a, b in _inside(text, *c.span(), taken, m)]
    return base, more


def _harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LEARN least values of each kind by their md5 in a task, and of the candidates that no base span meets."""
    least: list[dict[str, str]] = [{} for _ in range(len(BASE) + 1)]

    def cut() -> None:
        for k, x in enumerate(least):
            if len(x) > LEARN:
                least[k] = dict(sorted(x.items(), key=lambda i: i[1])[:LEARN])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            found = list(matches(text or ""))
            taken = Taken([m.span() for _, m in found])
            values = [(k, m[BASE[k][2]]) for k, m in found]
            values += [(len(BASE), c[0]) for c in _CANDIDATE.finditer(text or "") if not taken.meets(*c.span()) and _DIGIT.search(c[0]) and _LETTER.search(c[0])]
            for k, x in values:
                if len(x) <= LEARN_CHARS:
                    least[k][x] = hashlib.md5(x.encode()).hexdigest()
            if max(map(len, least)) > 8 * LEARN:
                cut()
    cut()
    rows = [(k, x, h) for k, d in enumerate(least) for x, h in d.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["kind", "value", "h"])


def learn(docs: DataFrame) -> Model:
    """A model from the labelled values of docs; without any it is that of the public formats."""
    got = Scratch(docs.sparkSession, "secrets")
    values = got.save(docs.select("text").mapInArrow(_harvest, "kind int, value string, h string").distinct(), "values")
    least = [[r["value"] for r in values.where(F.col("kind") == k).orderBy("h").limit(LEARN).collect()] for k in range(len(BASE) + 1)]
    got.drop(values)
    return fit(dict(enumerate(least[:-1])), least[-1])


KINDS = [name for name, *_ in BASE] + ["format"]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secrets(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """Spans of each row of docs, by a model learned from docs or a given one."""
    shared = docs.sparkSession.sparkContext.broadcast(m or learn(docs))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = scan(text or "", shared.value)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, SCHEMA)
