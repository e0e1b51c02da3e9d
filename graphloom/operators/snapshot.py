"""Snapshots: private builds, a pointer that is swapped last, artifacts, exports (SNK-1 to SNK-11, SRC-9/10, GR-10).

A generation is a folder of Parquet tables that is never changed. Readers open the generation that the pointer names,
so a build that dies leaves the last one in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MARKER = "_CURRENT", "_BUILDING"


class Store:
    """Generations under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """SNK-1: a temporary file, then a rename over the old one."""
        temp, final = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(temp, final):
            self._fs.delete(final, False)
            self._fs.rename(temp, final)

    def generation(self) -> str | None:
        pointer = self._read(POINTER)
        return json.loads(pointer)["generation"] if pointer else None

    def metadata(self) -> dict:
        return json.loads(self._read(POINTER) or "{}")

    def table(self, name: str, generation: str | None = None) -> DataFrame:
        g = generation or self.generation()
        if g is None:
            raise LookupError("nothing is published yet")
        return self.spark.read.parquet(f"{self.root}/{g}/{name}")

    def publish(self, tables: dict[str, DataFrame], check=lambda: True, **metadata) -> str:
        """SNK-2: writes a new generation, asks check() whether the inputs still hold, then swaps the pointer."""
        g = uuid.uuid4().hex
        self._fs.mkdirs(self._path(self.root))
        self._write(MARKER, g)
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{g}/{name}")
        if not check():
            self._fs.delete(self._path(f"{self.root}/{g}"), True)
            raise RuntimeError("the inputs changed during the build")
        self._write(POINTER, json.dumps({"generation": g, "previous": self.generation(), **metadata}, sort_keys=True))
        self._fs.delete(self._path(f"{self.root}/{MARKER}"), False)
        return g

    def prune(self) -> list[str]:
        """RES-21: removes generations but the current and the one before it, which answers what changed."""
        meta = self.metadata()
        old = [f.getPath() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory()]
        gone = [p for p in old if len(p.getName()) == 32 and p.getName() not in (meta.get("generation"), meta.get("previous"))]
        for p in gone:
            self._fs.delete(p, True)
        return [p.getName() for p in gone]

    def crashed(self) -> bool:
        """Whether a build began and did not end."""
        return self._read(MARKER) is not None


def save_artifacts(texts: DataFrame, path: str) -> DataFrame:
    """SNK-7: texts by the SHA-256 of their bytes, partitioned by its first byte; those already there are not written."""
    new = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text").dropDuplicates(["key"]).withColumn("part", F.substring("key", 1, 2))
    spark = texts.sparkSession
    try:
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("part").parquet(path)
    return new.select("key")


def artifact(spark: SparkSession, path: str, key: str) -> str | None:
    """The text of a key, read from one partition and checked against it."""
    row = spark.read.parquet(path).where((F.col("part") == key[:2]) & (F.col("key") == key)).where(F.sha2(F.col("text").cast("binary"), 256) == F.col("key")).select("text").first()
    return row and row[0]


def export(symbols: DataFrame, edges: DataFrame, path: str, repo: str, sha: str) -> None:
    """SNK-5: sorted JSON lines of symbols, and of edges whose two ends are among them."""
    from graphloom.operators.edges import connected

    symbols.orderBy("node_key").withColumn("repo", F.lit(repo)).withColumn("sha", F.lit(sha)).write.json(f"{path}/symbols")
    connected(edges, symbols).orderBy("source_key", "target_key", "relation").write.json(f"{path}/edges")


def markdown(rows: list[dict], columns: list[str], title: str) -> str:
    """SNK-9: a small report; nulls are shown as unknown, never as zero."""
    cell = lambda v: "unknown" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def dashboard(rows: list[dict], columns: list[str], title: str) -> str:
    """SNK-8: one HTML page of small collected rows, escaped."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('unknown' if r.get(c) is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
