"""A source tree as a Spark data source (SRC-1 to SRC-8): `spark.read.format("repo").load(folder)`.

The driver lists names and applies ignore rules; executors read, hash and classify contents. The folder must be
mounted on every machine. For a tree in an object store, `from_store` reads files by Spark's own reader.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from graphloom.functions.scalar import join_path, strip_jsonc
from graphloom.sources import ignore
from graphloom.sources.classify import ALWAYS_IGNORE, BANNER, BANNER_BYTES, MINIFIED_BYTES, MINIFIED_LINE, MOST_TEXT_BYTES, kind_of, looks_generated, omission

SCHEMA = "path string, size long, content_hash string, generated boolean, omission string, text string"
FILES_A_PARTITION = 256


def listed(root: str) -> list[str]:
    """Sorted paths of the files of a tree; symbolic links are not followed, ignored folders not entered."""
    out: list[str] = []

    def walk(folder: str, nested: list) -> None:
        here = os.path.join(root, folder)
        with os.scandir(here) as entries:
            items = sorted(entries, key=lambda e: e.name)
        if any(e.name == ".gitignore" and e.is_file(follow_symlinks=False) for e in items):
            with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="ignore") as f:
                nested = [*nested, (folder, ignore.rules(f.read()))]
        for e in items:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in ALWAYS_IGNORE and not ignore.ignored(path, True, nested):
                    walk(path, nested)
            elif e.is_file(follow_symlinks=False) and not ignore.ignored(path, False, nested):
                out.append(path)

    walk("", [])
    return sorted(out)


def fingerprint(data: bytes) -> str:
    """SRC-3: XXH3 of 64 bits, hexadecimal."""
    return xxhash.xxh3_64(data).hexdigest()


def generated(data: bytes) -> bool:
    """SRC-5 on bytes."""
    if re.search(BANNER.encode(), data[:BANNER_BYTES].lower()):
        return True
    return len(data) >= MINIFIED_BYTES and len(data) / (data.count(b"\n") + 1) > MINIFIED_LINE


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Part]:
        paths = listed(self.root)
        return [_Part(paths[i : i + FILES_A_PARTITION]) for i in range(0, len(paths), FILES_A_PARTITION)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            before = os.stat(full)
            with open(full, "rb") as f:
                data = f.read()
            after = os.stat(full)
            if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size):
                raise RuntimeError(f"{path} changed while it was read")
            why = "larger than 1 MiB" if len(data) > MOST_TEXT_BYTES else "binary" if b"\0" in data else None
            text = None
            if why is None:
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    why = "not UTF-8"
            yield path, len(data), fingerprint(data), generated(data), why, text


class RepoDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def _kinds(df: DataFrame) -> DataFrame:
    """Adds kind: by path, and generated for sources whose content says so; secrets have no text."""
    from graphloom.sources.classify import secret_path

    kind = kind_of("path")
    df = df.withColumn("kind", F.when((kind == "source") & F.col("generated"), "generated").otherwise(kind))
    secret = secret_path("path")
    return df.withColumn("omission", F.when(secret, "excluded path").otherwise(F.col("omission"))).withColumn("text", F.when(~secret, F.col("text")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, size, content_hash, generated, omission, text, kind of a tree on a mounted folder."""
    spark.dataSource.register(RepoDataSource)
    return _kinds(spark.read.format("repo").load(root))


def from_store(spark: SparkSession, root: str) -> DataFrame:
    """The same columns by Spark's reader of binary files, for stores that only Spark opens; ignore rules of the
    root's .gitignore only. The hash is a SHA-256 prefix, which Spark computes itself."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = df.select(F.min("path")).first()[0] or ""
    prefix = base[: base.find(root.rstrip("/").split("://")[-1]) + len(root.rstrip("/").split("://")[-1]) + 1]
    df = df.withColumn("path", F.expr(f"substring(path, {len(prefix) + 1})"))
    df = df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ALWAYS_IGNORE])))
    why = omission("path", F.col("content"))
    return _kinds(df.select("path", F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), looks_generated(F.col("content")).alias("generated"), why.alias("omission"), F.when(why.isNull(), F.col("content").cast("string")).alias("text")))


def config_digest(read, files: list[tuple[str, str]]) -> str:
    """SRC-8: one digest of every tsconfig and jsconfig at or above the folders of source and test files.

    read(path) gives a text or None; files are (path, kind). What a config extends counts too, ten deep.
    """
    import json

    folders = {""}
    for path, kind in files:
        if kind in ("source", "test"):
            parts = path.split("/")[:-1]
            folders |= {"/".join(parts[:i]) for i in range(len(parts) + 1)}
    h = hashlib.sha256()
    for folder in sorted(folders):
        for name in ("tsconfig.json", "jsconfig.json"):
            path, depth = (f"{folder}/{name}" if folder else name), 0
            while path and depth <= 10 and (text := read(path)) is not None:
                h.update(f"{path}\0{text}\0".encode())
                try:
                    more = json.loads(strip_jsonc(text)).get("extends")
                except (ValueError, AttributeError):
                    break
                path = join_path(path.rpartition("/")[0], more if more.endswith(".json") else f"{more}.json") if isinstance(more, str) and more.startswith(".") else None
                depth += 1
    return h.hexdigest()


