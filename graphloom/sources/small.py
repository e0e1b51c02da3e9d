"""Small local inputs of the evaluation: a subset of YAML, and tables of a SQLite file (SRC-10, SRC-15)."""

from __future__ import annotations

import json
import sqlite3
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

DEADLINE_S, SPLITS = 2.0, 8


def yaml_subset(text: str) -> object:
    """Mappings and lists by indentation; scalars are JSON strings, numbers, null, true, false, [] or {}.

    Anything else raises ValueError. Items of a list start with `- `, and a mapping may begin behind the dash.
    """
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip()]

    def value(word: str) -> object:
        try:
            return json.loads(word)
        except ValueError:
            raise ValueError(f"not a scalar: {word}") from None

    def read(depth: int) -> object:
        """The block at the head of rows, which are taken off as they are read."""
        out: list | dict = [] if rows[0][1].startswith("- ") else {}
        while rows and rows[0][0] == depth and rows[0][1].startswith("- ") == isinstance(out, list):
            _, line = rows.pop(0)
            if isinstance(out, list):
                item = line[2:].strip()
                opens = not item.startswith('"') and (item.endswith(":") or ": " in item)
                if opens:
                    rows.insert(0, (depth + 2, item))
                out.append(read(depth + 2) if opens else value(item))
                continue
            key, colon, rest = line.partition(":")
            if not colon:
                raise ValueError(f"no key: {line}")
            inner = not rest.strip() and rows and (rows[0][0] > depth or (rows[0][0] == depth and rows[0][1].startswith("- ")))
            out[key] = read(rows[0][0]) if inner else value(rest.strip() or "null")
        return out

    found = read(rows[0][0]) if rows else None
    if rows:
        raise ValueError(f"unexpected indentation: {rows[0][1]}")
    return found


class SqliteSource(DataSource):
    """Format `sqlite` with options path, table and schema (a DDL string): the table's rows, read only, by ranges of rowids.

    A split that takes longer than DEADLINE_S is stopped with an error. The file must be mounted where the splits run.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
        with _open(self.options["path"]) as c:
            rows = c.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` {kinds.get(t.upper(), 'string')}" for n, t in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields])


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // SPLITS))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        with _open(self.path) as c:
            end = time.monotonic() + DEADLINE_S
            c.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
            yield from c.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (first, last))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)
