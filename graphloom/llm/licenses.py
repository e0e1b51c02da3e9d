"""License scans: an Aho-Corasick automaton for notices and tags, a shunting-yard parser for expressions.

Texts are lower-cased (A-Z) and cut into words of letters, digits and whatever is not ASCII; the automaton finds the
places where a phrase's words stand consecutively, overlapping ones too. Where it finds an identifier tag, the
licence expression behind the tag is parsed with and, or, with, + and parentheses, and evaluated to the licences and
to how restrictive the choice leaves the text: of alternatives the freest, of a conjunction the strictest.

Nulls and edges: a null or empty text has no words, null first and last words, no labels and score 0; an expression
that does not parse gives the licences that it names and the strictest of them; repeated rows are scanned one by
one; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, binary, slices

#: The base phrases.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own notices.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl", "zlib license": "zlib",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0": "cc0", "released into the public domain": "public-domain",
    "permission is hereby granted free of charge to any person": "mit", "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary", "licensed under the apache": "apache", "free software foundation either version": "gpl",
}
TAGS = {"spdx license identifier": "#tag"}
#: How restrictive a family is, from 0 to 1.
STRICT = {"public-domain": 0.1, "cc0": 0.1, "0bsd": 0.1, "unlicense": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2, "apache": 0.3, "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "lgpl": 0.6, "gpl": 0.8, "agpl": 0.9, "proprietary": 1.0}
UNKNOWN = 0.7

_WORDS = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 32 for c in LOWER)
_TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def family(name: str) -> str:
    """The label of a licence identifier: its family, or the identifier itself."""
    name = name.rstrip("+")
    for start in ("agpl", "lgpl", "gpl", "apache", "mpl", "epl", "bsd", "isc", "zlib", "bsl", "cc0", "mit", "unlicense"):
        if name == start or name.startswith(f"{start}-"):
            return start
    return "cc-by" if name.startswith("cc-by") else name


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators in postfix order; raises ValueError if it does not parse."""
    out, stack, operand = [], [], False
    for token in _TOKEN.findall(expression):
        if token in _BINDS:
            if not operand:
                raise ValueError(token)
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError(token)
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                raise ValueError(token)
            stack.pop()
        else:
            if operand:
                raise ValueError(token)
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        raise ValueError(expression)
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """The families that an expression names, and how restrictive it is.

    `or` leaves the freest choice, `and` the strictest, and an exception takes a quarter off.
    """
    try:
        stack: list[tuple[set[str], float]] = []
        for token in postfix(expression):
            if token not in _BINDS:
                f = family(token)
                stack.append(({f}, STRICT.get(f, UNKNOWN)))
                continue
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x * 0.75) if token == "with" else (a | b, min(x, y) if token == "or" else max(x, y)))
        return stack[0]
    except ValueError:
        found = {family(t) for t in _TOKEN.findall(expression) if t not in _BINDS and t not in "()"}
        known = {f for f in found if f in STRICT}
        return known, max((STRICT[f] for f in known), default=0.0)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrases, base in ((NOTICES, False), (TAGS, False), (BASE, True)):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    ws = words(text)
    if not ws:
        return 0, 0, None, None, "", "", 0.0
    line = b" %b " % b" ".join(ws)
    starts, base, labels, tag, strict = [], set(), set(), False, 0.0
    for end, (size, label, is_base) in a.iter(line.decode("latin-1")):
        if label == "#tag":
            tag = True
            continue
        if is_base:
            starts.append(end - size + 1)
            base.add(label)
        labels.add(label)
        strict = max(strict, STRICT[label])
    if tag:
        for m in _TAG.finditer(text.translate(LOWER)):
            found, score = evaluate(m[1].decode("utf-8", "replace"))
            labels |= {f for f in found if "," not in f}
            strict = max(strict, score)
    at = [line.count(b" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return len(ws), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(labels)), strict


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licenses(docs: DataFrame) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in slices(batches):
            rows = [scan(t, a) for t in binary(batch, "text")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, SCHEMA)
