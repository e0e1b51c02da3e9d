"""Lookup, pagination and index health (FLT-1 to FLT-15, TK-1 to TK-3, AG-1 to AG-3, JN-7, JN-9)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import ancestors, ascii_lower, canonical, cursor, cursor_offset, like_pattern
from graphloom.operators.settle import settle

#: Work limits of a query.
MOST_ROWS, MOST_BYTES, AMBIGUOUS = 2000, 65536, 10


def find_files(files: DataFrame, kind: str | None = None, part: str | None = None, wildcards: bool = False) -> DataFrame:
    """Files of a kind whose path contains part: literally and case-sensitively, or (wildcards) as an ASCII-folded LIKE."""
    out = files.where(F.col("kind") == kind) if kind else files
    if part:
        out = out.where(like_pattern("path", part) if wildcards else F.instr("path", part) > 0)
    return out.orderBy("path")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """`a::b` is a qualified name and nothing else; otherwise exact names, or, without any, names that contain it."""
    if "::" in name:
        return symbols.where(F.col("qualified_name") == name)
    near = symbols.where((F.col("name") == name) | (F.instr(ascii_lower("name"), ascii_lower(F.lit(name))) > 0)).withColumn("__exact", F.col("name") == name)
    # one row says whether any is exact; it meets the few near rows
    any_exact = near.agg(F.coalesce(F.max("__exact"), F.lit(False)).alias("__any"))
    return near.crossJoin(F.broadcast(any_exact)).where("__exact = __any").drop("__exact", "__any")


def resolve_targets(symbols: DataFrame, files: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """A file of that very path, unless a file is given; else the symbols of find_symbol, in that file if given."""
    cols = ["node_key", "name", "qualified_name", "file_path", "start_line"]
    found = find_symbol(symbols, name).select(*cols)
    if file is not None:
        return found.where(F.col("file_path") == file)
    exact = files.where(F.col("path") == name).select(F.col("path").alias("node_key"), F.col("path").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    return exact.union(found.join(exact.select(F.lit(1).alias("x")), F.lit(True), "left_anti"))


def matching(symbols: DataFrame, files: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """At most AMBIGUOUS + 1 targets in order; more than AMBIGUOUS is an ambiguous name."""
    return resolve_targets(symbols, files, name, file).orderBy("file_path", "start_line", "node_key").limit(AMBIGUOUS + 1)


def list_symbols(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file_path") == file).orderBy("start_line", "node_key")


def in_scope(symbols: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """Symbols whose file is of the scope's kind; `all` keeps every one."""
    return symbols if scope == "all" else symbols.join(files.where(F.col("kind") == scope).select(F.col("path").alias("file_path")), "file_path", "left_semi")


def brief(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", F.coalesce("qualified_name", "file_path").alias("symbol_id"), "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "end_line")


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The frame, or an error if it has more rows than most; nothing is cut silently."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; narrow the query")
    return df


def nearest_ancestor(rows: DataFrame, path: str, marks: DataFrame) -> DataFrame:
    """JN-7: each row's deepest ancestor folder that is in marks (folder, ...); rows without one are left out."""
    up = rows.withColumn("__a", F.explode(ancestors(path))).join(marks.withColumnRenamed("folder", "__a"), "__a")
    depth = F.when(F.col("__a") == "", 0).otherwise(F.size(F.split("__a", "/")))
    best = up.groupBy(*rows.columns).agg(F.max_by(F.struct("__a", *[c for c in marks.columns if c != "folder"]), depth).alias("__m"))
    return best.select(*rows.columns, F.col("__m.__a").alias("folder"), *[F.col(f"__m.{c}").alias(c) for c in marks.columns if c != "folder"])


def page(ordered: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of the order; top rows are taken without a full sort in one task."""
    top = ordered.orderBy(*order).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") > offset)


@dataclass
class Envelope:
    """A page of a query on one generation, with hashes of the files it cites."""

    generation: str
    items: list = field(default_factory=list)
    files: dict = field(default_factory=dict)
    truncated: bool = False
    limit_reason: str | None = None
    next_cursor: str | None = None
    schema_version: int = 2


def query_key(operation: str, arguments: dict) -> str:
    return hashlib.sha256(canonical([operation, arguments]).encode()).hexdigest()


def execute(frame: DataFrame, order: list, files: DataFrame, generation: str, operation: str, arguments: dict, limit: int = 50, max_bytes: int = MOST_BYTES, at: str | None = None) -> Envelope:
    """A page in order, shrunk until its JSON fits max_bytes, with a cursor to the rest (TK-2/3, PK-4)."""
    if not 1 <= limit <= 200 or max_bytes < 1:
        raise ValueError("limit must be 1 to 200 and max_bytes positive")
    key = query_key(operation, arguments)
    start = cursor_offset(at, generation, key) if at else 0
    rows = [r.asDict(recursive=True) for r in frame.orderBy(*order).offset(start).limit(limit + 1).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    out = Envelope(generation, truncated=more, limit_reason="limit" if more else None)
    while rows and len(canonical(rows).encode()) > max_bytes:
        rows.pop()
        out.truncated, out.limit_reason = True, "bytes"
    out.items = rows
    cited = {r.get("file") or r.get("file_path") or r.get("path") for r in rows} - {None}
    if cited:
        out.files = {r["path"]: r["content_hash"] for r in files.where(F.col("path").isin(*sorted(cited))).select("path", "content_hash").collect()}
    if out.truncated and rows:
        out.next_cursor = cursor(generation, key, start + len(rows))
    return out


def health(old: DataFrame | None, new: DataFrame, versions: tuple = (), expected: tuple = (), most: int = MOST_ROWS) -> dict:
    """FLT-15: not_indexed, invalid (other versions), stale (changed files) or ready, with what changed.

    Of each kind of change the first `most` paths are listed, and all are counted.
    """
    if old is None:
        return {"state": "not_indexed", "added": [], "removed": [], "changed": [], "n_changes": 0}
    a, b = old.select("path", F.struct("content_hash", "kind").alias("o")), new.select("path", F.struct("content_hash", "kind").alias("n"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    found = settle(both.select("path", change.alias("change")).where("change IS NOT NULL"))
    # no task and no driver holds more than the first of each kind
    first = found.withColumn("place", F.row_number().over(W.partitionBy("change").orderBy("path"))).where(F.col("place") <= most)
    lists: dict[str, list] = {k: [] for k in ("added", "removed", "changed")}
    for r in first.orderBy("change", "place").collect():
        lists[r["change"]].append(r["path"])
    n = found.count()
    return {"state": "invalid" if versions != expected else "stale" if n else "ready", **lists, "n_changes": n}
