"""What the operators share: the text rules, scratch tables in the shared folder, and grouped Arrow streams."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.settle import forget_at_exit, shared_dir

#: A-Z to a-z and nothing else; bytes.split() then cuts at exactly 0x20 and 0x09-0x0D.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The word rule `[^\x20\x09-\x0D]+` for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_within: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Removes the scratch tables made inside at its end, when what is built on them has been written."""
    _within.append([])
    try:
        yield
    finally:
        for made in _within.pop():
            made.remove()


class Scratch:
    """Parquet tables in the shared folder that cut lineage; an executor's loss costs no more than a reread.

    They are gone when temporary() ends, or when the driver does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        forget_at_exit(spark, self.root)
        if _within:
            _within[-1].append(self)

    def remove(self) -> None:
        """Removes all its tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{name}-{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no unread result is built on."""
        for t in tables:
            self._delete(t._scratch)


def binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes, so that one batch of long texts is not held several times over."""
    for batch in batches:
        size = max(1, batch.nbytes)
        step = max(1, batch.num_rows * most_bytes // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    trim()


def trim() -> None:
    """Gives free memory back to the machine at the end of a task, as Python workers outlive it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by a long key: tables with the bounds of their groups.

    The last group of a batch waits for the next batch, so memory is a batch and one group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if rest and cut == 0 and rest[-1].column(key)[0].as_py() == k[0]:
            rest.append(batch)
            continue
        whole = pa.Table.from_batches([*rest, batch.slice(0, cut)])
        if whole.num_rows:
            yield whole, bounds(whole.column(key).to_numpy())
        rest = [batch.slice(cut)]
    if rest:
        whole = pa.Table.from_batches(rest)
        yield whole, bounds(whole.column(key).to_numpy())
    trim()


def bounds(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def grouped(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """Streams groups of a long key through fn without a call a group; for groups of a known most size only."""
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(fn, schema)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def hashed(column: str):
    """md5 of the id as text: the order of bounded samples."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def share_of(wanted: float, of: int) -> str:
    """The first eight digits of an md5 up to which about `wanted` of so many rows lie."""
    return f"{min(0xFFFFFFFF, int(0xFFFFFFFF * wanted / max(1, of)) + 200_000_000 // max(1, of)):08x}"
