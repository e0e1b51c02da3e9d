"""Module resolution as joins with the file list (RES-2 to RES-4, SRC-7, JN-6)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import ancestors, folder, join_path, strip_jsonc

JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: A file imported as .js may be written in TypeScript.
TWINS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
MOST_EXTENDS = 3


def _first(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (keys, file, priority, confidence) the first one that is a file."""
    found = candidates.join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return found.groupBy(*keys).agg(F.min_by(F.struct("file", "confidence"), "priority").alias("b")).select(*keys, "b.file", "b.confidence")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, level, file, confidence) of imports (path, spec, level).

    A relative import starts at its package; an absolute one at the root, then the importer's own folders from the
    top, then src and lib. x.py goes before x/__init__.py. Anything but the root and relative is 0.9.
    """
    one = imports.select("path", "spec", "level").distinct()
    up = ancestors("path")
    own = F.slice(up, 1, F.size(up) - F.col("level") + 1)
    relative = F.array(F.element_at(own, -1))
    absolute = F.array_distinct(F.concat(F.array(F.lit("")), F.slice(up, 2, F.size(up)), F.array(F.lit("src"), F.lit("lib"))))
    roots = F.when((F.col("level") > 0) & (F.col("level") <= F.size(up)), relative).when(F.col("level") == 0, absolute)
    c = one.select("path", "spec", "level", F.posexplode(roots).alias("k", "root"))
    base = F.array_join(F.filter(F.array(F.col("root"), F.replace("spec", F.lit("."), F.lit("/"))), lambda x: x != ""), "/")
    c = c.withColumn("base", base).where("base <> '' OR level > 0")
    c = c.select("path", "spec", "level", "k", F.posexplode(F.array(F.concat("base", F.lit(".py")), F.regexp_replace(F.concat("base", F.lit("/__init__.py")), "^/", ""))).alias("j", "file"))
    c = c.withColumn("priority", F.col("k") * 2 + F.col("j")).withColumn("confidence", F.when((F.col("level") > 0) | (F.col("k") == 0), 1.0).otherwise(0.9))
    return _first(c, files, ["path", "spec", "level"])


def javascript_candidates(base: str | None) -> list[str]:
    """Files that a path without more may mean, in order."""
    if not base:
        return []
    out = [base]
    for ext, twins in TWINS.items():
        if base.endswith(ext):
            out += [base[: -len(ext)] + t for t in twins]
    return out + [base + e for e in JS] + [f"{base}/index{e}" for e in JS]


def read_configs(paths: list[str], read: Callable[[str], str | None]) -> list[dict]:
    """tsconfig.json and jsconfig.json as rows (folder, base_url, patterns); local extends up to three deep."""

    def load(path: str, depth: int = 0) -> dict:
        try:
            value = json.loads(strip_jsonc(read(path) or "{}"))
        except ValueError:
            return {}
        here = path.rpartition("/")[0]
        out: dict = {}
        more = value.get("extends")
        if isinstance(more, str) and more.startswith(".") and depth < MOST_EXTENDS:
            target = join_path(here, more if more.endswith(".json") else f"{more}.json")
            out = load(target, depth + 1) if target else {}
        options = value.get("compilerOptions") or {}
        if "baseUrl" in options:
            out["base_url"] = join_path(here, options["baseUrl"])
        if "paths" in options:
            out["patterns"] = [(k, [join_path(out.get("base_url", here) or "", t) for t in v]) for k, v in options["paths"].items()]
        return out

    return [{"folder": p.rpartition("/")[0], "base_url": None, "patterns": [], **load(p)} for p in sorted(paths) if p.rpartition("/")[2] in ("tsconfig.json", "jsconfig.json")]


def resolve_javascript(imports: DataFrame, files: DataFrame, configs: list[dict] = ()) -> DataFrame:
    """(path, spec, level, file, confidence): relative specs, then the nearest config's aliases and base."""
    by_folder = {c["folder"]: c for c in configs}

    @F.udf("array<struct<file: string, confidence: double>>", useArrow=True)
    def candidates(path: str, spec: str):
        here = path.rpartition("/")[0]
        if spec.startswith("."):
            return [{"file": f, "confidence": 1.0} for f in javascript_candidates(join_path(here, spec))]
        while True:
            config = by_folder.get(here)
            if config or not here:
                break
            here = here.rpartition("/")[0]
        out: list[str] = []
        if config:
            for pattern, targets in config["patterns"]:
                head, star, tail = pattern.partition("*")
                if (star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail)) or spec == pattern:
                    middle = spec[len(head) : len(spec) - len(tail)] if star else ""
                    out += [f for t in targets if t for f in javascript_candidates(t.replace("*", middle))]
                    break
            if config["base_url"] is not None:
                out += javascript_candidates(join_path(config["base_url"], spec))
        return [{"file": f, "confidence": 0.9} for f in out]

    one = imports.select("path", "spec", "level").distinct()
    c = one.select("path", "spec", "level", F.posexplode(candidates("path", "spec")).alias("priority", "c")).select("path", "spec", "level", "priority", "c.*")
    return _first(c, files, ["path", "spec", "level"])


def resolve_modules(imports: DataFrame, files: DataFrame, configs: list[dict] = ()) -> DataFrame:
    """(path, spec, level, file, confidence) of every import that is a file; one that is not is external."""
    python = F.col("path").endswith(".py")
    return resolve_python(imports.where(python), files).union(resolve_javascript(imports.where(~python), files, configs))


def containers(files: DataFrame) -> DataFrame:
    """RES-22: (source_key, target_key, relation): folders that contain folders and files."""
    up = files.select("path", F.explode(ancestors("path")).alias("a"))
    inner = up.where("a <> ''").select(folder("a").alias("source_key"), F.col("a").alias("target_key")).distinct()
    own = files.select(folder("path").alias("source_key"), F.col("path").alias("target_key"))
    return inner.union(own).where("source_key <> ''").withColumn("relation", F.lit("CONTAINS"))
