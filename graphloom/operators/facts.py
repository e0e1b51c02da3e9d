"""Extraction over files: one row of facts a source, and tables of them (EXT-1, EXT-14)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import extract_javascript, extract_python
from graphloom.operators.settle import settle

VERSION = 3
_REF = "name: string, receiver: string, line: int"
FACTS = (
    "symbols array<struct<name: string, kind: string, qualname: string, first: int, last: int>>, "
    "imports array<struct<spec: string, level: int, line: int, local: string, member: string, first: int, last: int>>, "
    f"calls array<struct<{_REF}>>, bases array<struct<class_qualname: string, line: int, name: string, receiver: string>>, values array<struct<{_REF}>>, "
    "reexports array<struct<spec: string, level: int, imported: string, exported: string>>, locals array<struct<name: string, first: int, last: int>>, "
    "aliases array<struct<alias: string, name: string, receiver: string>>, default_export string, error string"
)


def facts_of(path: str, text: str | None) -> dict:
    """Facts of a source by its extension; a language that is not read has none."""
    if text is None:
        return extract_python.empty() | {"error": "no text"}
    if path.endswith(".py"):
        return extract_python.extract(text)
    if path.endswith(extract_javascript.EXTENSIONS):
        try:
            return extract_javascript.extract(text)
        except (RecursionError, IndexError) as e:
            return extract_python.empty() | {"error": f"not read: {e}"}
    return extract_python.empty()


def extracted(files: DataFrame) -> DataFrame:
    """path, content_hash, version and the facts of files (path, content_hash, text); each text is parsed where it is."""

    def fn(batches):
        for pdf in batches:
            rows = [{"path": p, "content_hash": h, "version": VERSION, **facts_of(p, t)} for p, h, t in zip(pdf["path"], pdf["content_hash"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content_hash", "version", *extract_python.empty()])

    return files.select("path", "content_hash", "text").mapInPandas(fn, f"path string, content_hash string, version int, {FACTS}")


def refreshed(files: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Facts of files; those of the same path, hash and version are taken from the previous snapshot, unparsed."""
    if previous is None:
        return extracted(files)
    key = files.select("path", "content_hash")
    kept = previous.where(F.col("version") == VERSION).join(key, ["path", "content_hash"], "left_semi")
    return kept.unionByName(extracted(files.join(kept.select("path"), "path", "left_anti")))


def settle_facts(facts: DataFrame) -> DataFrame:
    """Facts written once, so that no source is parsed twice in a build."""
    return settle(facts)


def rows_of(facts: DataFrame, column: str) -> DataFrame:
    """The structs of an array column as rows with their path and place."""
    return facts.select("path", F.posexplode(column).alias("place", "x")).select("path", "place", "x.*")
