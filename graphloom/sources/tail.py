"""A growing file of JSON lines as a stream by byte offsets (SRC-12, SM-2, SM-3): `spark.readStream.format("tail")`.

A batch holds whole lines only: what stands behind the last line feed waits. A line beyond 8 MiB is a row without a
value. A file that was cut or replaced (its head has another digest) is read from its start as a new epoch. The
query's checkpoint keeps the offset, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

MOST_LINE, MOST_BATCH, HEAD = 8 << 20, 32 << 20, 256


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _head(self, size: int) -> str:
        with open(self.path, "rb") as f:
            return hashlib.sha256(f.read(min(size, HEAD))).hexdigest()

    def initialOffset(self) -> dict:
        return {"at": 0, "epoch": 0, "head": ""}

    def _lines(self, a: int, z: int) -> list[tuple[int, str | None]]:
        with open(self.path, "rb") as f:
            f.seek(a)
            data = f.read(z - a)
        out, at = [], a
        for line in data.split(b"\n")[:-1]:
            out.append((at, None if len(line) > MOST_LINE else line.decode("utf-8", "replace")))
            at += len(line) + 1
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        size = os.path.getsize(self.path)
        at, epoch = start["at"], start["epoch"]
        if at and (size < at or self._head(at) != start["head"]):
            at, epoch = 0, epoch + 1
        z = min(size, at + MOST_BATCH)
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(z - at)
            while b"\n" not in data and z < size:  # one line beyond the batch
                more = f.read(MOST_BATCH)
                data, z = data + more, z + len(more)
        end = at + data.rfind(b"\n") + 1
        return iter([(epoch, o, v) for o, v in self._lines(at, end)]), {"at": end, "epoch": epoch, "head": self._head(end) if end else ""}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        a = start["at"] if start["epoch"] == end["epoch"] else 0
        return iter([(end["epoch"], o, v) for o, v in self._lines(a, end["at"])])


class TailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "epoch long, seq long, value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Tail(self.options["path"])
