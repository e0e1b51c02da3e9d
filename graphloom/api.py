"""The engine's public face: scan a source tree, then ask questions of the published snapshot (2.19).

    engine = Engine(spark, "hdfs://.../index")
    engine.scan("/mnt/src")
    engine.callers("pkg.core.helper", depth=2).items
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import ancestors, base_name, folder, words
from graphloom.operators import edges as E
from graphloom.operators import facts, graph, lookup, modules, pack, resolve, snapshot, text
from graphloom.operators.lookup import Envelope
from graphloom.operators.settle import settle
from graphloom.sources import repo

VERSIONS = {"facts": facts.VERSION, "edges": 2, "chunks": 2}


class Engine:
    """Questions are set-oriented DataFrame plans over one immutable generation; a page of rows comes to the driver."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.packets = spark, snapshot.Store(spark, store), pack.Packets()

    # -- build

    def scan(self, root: str) -> dict:
        """Reads a tree, parses what changed, resolves references and publishes a generation; a no-op if all is as before."""
        files = repo.scan(self.spark, root).select("path", "kind", "content_hash", "omission", "text")
        inputs = files.select("path", "kind", "content_hash")
        old = self.store.table("files") if self.store.generation() else None

        def read(path: str) -> str | None:
            full = os.path.join(root, path)
            if not os.path.isfile(full):
                return None
            with open(full, encoding="utf-8", errors="replace") as f:
                return f.read()

        # configurations are few; those count that are in or above a folder of sources or tests
        named = inputs.where(base_name("path").isin("tsconfig.json", "jsconfig.json")).select("path", folder("path").alias("folder"))
        above = inputs.where("kind IN ('source', 'test')").select(F.explode(ancestors("path")).alias("folder")).distinct()
        listed = [r["path"] for r in named.select("path").collect()]
        digest = repo.config_digest(read, [(r["path"], "source") for r in named.join(above, "folder", "left_semi").select("path").collect()])
        meta = self.store.metadata()
        state = lookup.health(old, inputs, (meta.get("versions"), meta.get("config")), (VERSIONS, digest))
        if state["state"] == "ready":
            return {"generation": self.store.generation(), **state, "rebuilt": False}
        code = files.where("kind IN ('source', 'test') AND omission IS NULL")
        usable = old is not None and meta.get("versions") == VERSIONS
        # a change that no reference can see leaves the edges as they are (RES-21)
        alike = usable and meta.get("config") == digest and E.difference(old.where("kind IN ('source', 'test')"), inputs.where("kind IN ('source', 'test')"), ["path"], ["kind", "content_hash"]).isEmpty()
        if alike:
            tables = {n: self.store.table(n) for n in ("facts", "symbols", "edges", "edges_out")}
        else:
            known = facts.settle_facts(facts.refreshed(code, self.store.table("facts") if usable else None))
            configs = modules.read_configs(listed, read)
            built = resolve.build_edges(known, code.select("path"), configs)
            kind = files.select(F.col("path").alias("file_path"), F.col("kind").alias("file_kind"), "content_hash")
            symbols = built["symbols"].select("node_key", "name", F.col("node_key").alias("qualified_name"), "kind", F.col("path").alias("file_path"), F.col("first").alias("start_line"), F.col("last").alias("end_line")).join(kind, "file_path", "left")
            tables = {"facts": known, "symbols": symbols, "edges": E.ordered(built["edges"], "target_key"), "edges_out": E.ordered(built["edges"], "source_key")}
        evidence = files.where("omission IS NULL AND kind IN ('source', 'test', 'doc', 'config')")
        chunks = settle(text.chunks_refreshed(evidence.select("path", F.col("kind").alias("scope"), "content_hash", "text"), self.store.table("chunks") if usable else None))
        hold = lambda: repo.scan(self.spark, root).select("path", "kind", "content_hash").exceptAll(inputs).isEmpty()
        tables |= {"files": inputs.withColumn("size", F.lit(None).cast("long")), "texts": evidence.select("path", "content_hash", "text"), "containers": modules.containers(inputs), "chunks": chunks}
        tables |= {"postings": text.postings(chunks, ["path", "start_line", "end_line"], "terms", ("scope",)), "statistics": text.statistics(chunks, "terms")}
        g = self.store.publish(tables, check=hold, versions=VERSIONS, config=digest)
        self.store.prune()
        counts = {r["relation"]: r["n"] for r in E.counts(self.store.table("edges")).collect()}
        return {"generation": g, **state, "rebuilt": True, "edges_kept": alike, "symbols": self.store.table("symbols").count(), "edges": counts}

    def doctor(self, root: str) -> dict:
        """Whether the index stands for the tree as it is."""
        old = self.store.table("files") if self.store.generation() else None
        return {**lookup.health(old, repo.scan(self.spark, root).select("path", "kind", "content_hash")), "crashed": self.store.crashed()}

    def fresh(self, root: str, question, attempts: int = 2):
        """SM-10: question(engine) on an index that stands for the tree before and after; tried again if it changed."""
        for _ in range(attempts):
            self.scan(root)
            out = question(self)
            if self.doctor(root)["state"] == "ready":
                return out
        raise RuntimeError("the tree keeps changing")

    # -- questions

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def _page(self, frame: DataFrame, order: list, operation: str, arguments: dict, limit: int, cursor: str | None, max_bytes: int) -> Envelope:
        return lookup.execute(frame, order, self._table("files"), self.store.generation(), operation, arguments, limit, max_bytes, cursor)

    def find_files(self, kind: str | None = None, name: str | None = None, limit: int = 50, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        return self._page(lookup.find_files(self._table("files"), kind, name).select("path", "kind"), ["path"], "find_files", {"kind": kind, "name": name}, limit, cursor, max_bytes)

    def find_symbol(self, name: str, scope: str = "all", limit: int = 50, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        found = lookup.in_scope(lookup.find_symbol(self._table("symbols"), name), self._table("files"), scope)
        return self._page(lookup.brief(found), ["file", "line", "symbol_id"], "find_symbol", {"name": name, "scope": scope}, limit, cursor, max_bytes)

    def list_symbols(self, file: str, limit: int = 200, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        return self._page(lookup.brief(lookup.list_symbols(self._table("symbols"), file)), ["line", "symbol_id"], "list_symbols", {"file": file}, limit, cursor, max_bytes)

    def _targets(self, name: str, file: str | None) -> DataFrame:
        found = lookup.matching(self._table("symbols"), self._table("files"), name, file)
        rows = [r["node_key"] for r in found.collect()]
        if len(rows) > lookup.AMBIGUOUS:
            raise ValueError(f"{name} is ambiguous; name its file or use a qualified name")
        return self.spark.createDataFrame([(r,) for r in rows], "node_key string")

    def _reach(self, operation: str, name: str, depth: int, file: str | None, relations, candidates: bool, limit: int, cursor: str | None, max_bytes: int) -> Envelope:
        found = graph.reach(self._table("edges"), self._targets(name, file), depth, True, relations, candidates)
        s = self._table("symbols").select("node_key", "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"))
        rows = found.join(s, "node_key", "left").withColumn("confidence", F.round("confidence", 4)).withColumn("file", F.coalesce("file", "node_key"))
        order = ["distance", F.col("confidence").desc(), "file", F.coalesce("line", F.lit(0)), "node_key", "of"]
        out = self._page(rows, order, operation, {"name": name, "depth": depth, "file": file, "relations": relations, "candidates": candidates}, limit, cursor, max_bytes)
        if not out.items:
            out.limit_reason = pack.empty(f"{operation} of {name}, depth {depth}")["claim"]
        return out

    def callers(self, name: str, depth: int = 1, file: str | None = None, candidates: bool = False, limit: int = 50, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        return self._reach("callers", name, depth, file, ("CALLS",), candidates, limit, cursor, max_bytes)

    def dependents(self, name: str, depth: int = 1, file: str | None = None, candidates: bool = False, limit: int = 50, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        return self._reach("dependents", name, depth, file, E.RELATIONS, candidates, limit, cursor, max_bytes)

    def trace_path(self, source: str, target: str, max_hops: int = 6, relations=("CALLS",), candidates: bool = False) -> dict:
        return graph.trace(self._table("edges_out"), self._targets(source, None), self._targets(target, None), max_hops, relations, candidates).first().asDict()

    def impact(self, names: list[str], depth: int = 2, scopes: tuple[str, ...] | None = None, limit: int = 50, cursor: str | None = None, max_bytes: int = lookup.MOST_BYTES) -> Envelope:
        """GR-9: what a change of symbols or files may reach; a file stands for its symbols too."""
        seeds = None
        for n in names:
            seeds = self._targets(n, None) if seeds is None else seeds.union(self._targets(n, None))
        inner = self._table("symbols").join(seeds.withColumnRenamed("node_key", "file_path"), "file_path", "left_semi").select("node_key")
        kinds = self._table("files").select(F.col("path").alias("file_path"), F.col("kind").alias("k"))
        nodes = self._table("symbols").select("node_key", "file_path").join(kinds, "file_path", "left").select("node_key", F.col("k").alias("kind")).union(kinds.select("file_path", "k"))
        found = graph.impact(self._table("edges"), seeds.union(inner).distinct(), nodes, depth, True, E.RELATIONS, scopes)
        return self._page(found, ["distance", "node_key", "seed"], "impact", {"names": names, "depth": depth, "scopes": scopes}, limit, cursor, max_bytes)

    def changed(self, generation: str) -> DataFrame:
        """GR-10: symbols that were added, removed or changed since another generation."""
        cols = ["kind", "start_line", "end_line", "content_hash"]
        return E.difference(self.store.table("symbols", generation), self._table("symbols"), ["node_key"], cols)

    # -- evidence

    def context(self, task: str, targets: list[str] = (), budget_tokens: int | None = None, at: int = 0, scopes: tuple[str, ...] = ("source", "test", "doc", "config")) -> dict:
        """Exact targets, then the best chunks of the task with files taking turns, packed into a budget."""
        budget = pack.budget_bytes(budget_tokens, None)
        return self.packets.get((self.store.generation(), task, tuple(targets), at, budget, scopes), lambda: self._context(task, list(targets), budget, at, scopes))

    def _context(self, task: str, targets: list[str], budget: int, at: int, scopes: tuple[str, ...]) -> dict:
        chunks = self._table("chunks")
        query = text.query_terms(self.spark.createDataFrame([(task,)], "text string"))
        best = text.search(self._table("postings"), self._table("statistics"), query, ["path", "start_line", "end_line"], keep=F.col("scope").isin(*scopes))
        turns = text.round_robin(best, "path", [F.col("score").desc(), F.col("path"), F.col("start_line")])
        exact, missing = text.exact_tier(self._table("symbols"), chunks, self.spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "target string"))
        merged = text.merged(exact, turns)
        body = chunks.select("path", "start_line", "end_line", "heading", "body")
        hashes = self._table("files").select("path", "content_hash")
        rows = merged.join(body, ["path", "start_line", "end_line"], "left").join(hashes, "path", "left").orderBy("place", "path", "start_line").collect()
        items = [{"path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"], "reason": r["reason"], "heading": r["heading"], "text": r["body"]} for r in rows]
        out = pack.pack(items, {r["path"]: r["content_hash"] for r in rows}, budget, at)
        out["unresolved"] = [r["target"] for r in missing.collect()]
        out["instructions"] = text.instruction_files(merged.select("path").distinct(), self._table("files"))
        return out

    def read(self, path: str, first: int, last: int, expected_hash: str) -> str | None:
        """TX-8: exact lines of the hash that a packet named, or None if the snapshot has another."""
        row = text.read_range(self._table("texts"), path, first, last, expected_hash).first()
        return row and row["text"]

    def export(self, path: str, name: str, sha: str) -> None:
        snapshot.export(self._table("symbols"), self._table("edges"), path, name, sha)

    def artifact_save(self, texts: list[str]) -> list[str]:
        return [r["key"] for r in snapshot.save_artifacts(self.spark.createDataFrame([(t,) for t in texts], "text string"), f"{self.store.root}/artifacts").collect()]

    def artifact_read(self, key: str) -> str | None:
        return snapshot.artifact(self.spark, f"{self.store.root}/artifacts", key)
