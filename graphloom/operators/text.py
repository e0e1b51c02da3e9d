"""Text retrieval: chunks, BM25, exact tier, diversification, condensed logs (TX-1 to TX-6, TX-8, TX-9, JN-13, WN-2, WN-6, EXT-17/18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import ancestors, words
from graphloom.operators.settle import settle

#: Limits of chunks, queries and results; BM25's constants.
CHUNK_LINES, CHUNK_BYTES, HEADING_CHARS, QUERY_TERMS, TOP = 32, 4096, 200, 32, 200
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def chunks(docs: DataFrame, path: str = "path", scope: str = "scope", text: str = "text") -> DataFrame:
    """(path, scope, start_line, end_line, heading, body): greedy chunks of whole lines.

    A chunk ends before the line that would be its 33rd, exceed 4,096 bytes, or be a heading of a doc. The lines of a
    text are folded in one expression, so a text stays one row until its chunks are known.
    """
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)), lambda x: x)
    zero = F.struct(
        F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("heading"),
        F.array().cast("array<struct<start:int,n:int,heading:string>>").alias("done"),
    )

    def add(acc: Column, line: Column) -> Column:
        size = F.octet_length(line).cast("long")
        head = (F.col(scope) == "doc") & line.startswith("#")
        full = (acc["n"] > 0) & ((acc["n"] >= CHUNK_LINES) | (acc["bytes"] + size > CHUNK_BYTES) | head)
        one = F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("n"), acc["heading"].alias("heading")))
        return F.struct(
            F.when(full, acc["start"] + acc["n"]).otherwise(acc["start"]).alias("start"),
            F.when(full, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, size).otherwise(acc["bytes"] + size).alias("bytes"),
            F.when(head, F.substring(F.trim(F.regexp_replace(line, r"\s+$", "")), 1, HEADING_CHARS)).otherwise(acc["heading"]).alias("heading"),
            F.when(full, F.concat(acc["done"], one)).otherwise(acc["done"]).alias("done"),
        )

    last = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("n"), acc["heading"].alias("heading"))))).otherwise(acc["done"])
    rows = docs.select(F.col(path).alias("path"), F.col(scope).alias("scope"), lines.alias("lines"))
    rows = rows.withColumn("c", F.explode(F.aggregate("lines", zero, add, last)))
    body = F.array_join(F.expr("slice(lines, c.start, c.n)"), "")
    return rows.select("path", "scope", F.col("c.start").alias("start_line"), F.expr("c.start + c.n - 1").alias("end_line"), F.col("c.heading").alias("heading"), body.alias("body"))


def query_terms(query: DataFrame, text: str = "text") -> DataFrame:
    """(term): the first 32 distinct words of a query, which is one row."""
    return query.select(F.explode(F.slice(F.array_distinct(words(text)), 1, QUERY_TERMS)).alias("term"))


def postings(units: DataFrame, key: list[str], terms: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, carry, dl, tf): the words of units, in the order of terms, so that a query reads those of its own terms.

    Counting is whole within a task, as a unit is a row; ranges of terms keep a frequent word's rows in several files.
    """
    each = units.select(*key, *carry, F.size(terms).alias("dl"), F.explode(terms).alias("term"))
    return each.groupBy("term", *key, *carry, "dl").agg(F.count("*").cast("int").alias("tf")).repartitionByRange("term", *key).sortWithinPartitions("term", *key)


def statistics(units: DataFrame, terms: str) -> DataFrame:
    """One row: the number of units and their mean length."""
    return units.agg(F.count("*").alias("n"), F.avg(F.size(terms)).alias("mean"))


def search(posted: DataFrame, stats: DataFrame, query: DataFrame, key: list[str], keep: Column | None = None, top: int = TOP) -> DataFrame:
    """(key, score): the best units for the query's terms by BM25, from postings and statistics of all units.

    keep only chooses what is returned. The query's terms are at most QUERY_TERMS and reach the scan of the postings.
    """
    wanted = [r["term"] for r in query.limit(QUERY_TERMS).collect()]
    rows = posted.where(F.col("term").isin(*wanted) if wanted else F.lit(False))
    df = rows.groupBy("term").agg(F.count("*").alias("__df"))
    joined = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    if keep is not None:
        joined = joined.where(keep)
    # parts are summed in the order of terms, so sums agree between runs
    score = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("term", part.alias("p")))), lambda x: x["p"]), F.lit(0.0), lambda a, x: a + x)
    return joined.groupBy(*key).agg(score.alias("score")).orderBy(F.col("score").desc(), *key).limit(top)


def bm25(units: DataFrame, key: list[str], terms: str, query: DataFrame, keep: Column | None = None, top: int = TOP) -> DataFrame:
    """search() of units that have no postings yet: their words are read once and settled."""
    wanted = [r["term"] for r in query.limit(QUERY_TERMS).collect()]
    hits = F.filter(terms, lambda w: w.isin(*wanted) if wanted else F.lit(False))
    carry = [keep.alias("__keep")] if keep is not None else []
    sized = settle(units.select(*key, F.size(terms).alias("dl"), hits.alias("__hits"), *carry))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    tf = sized.withColumn("term", F.explode("__hits")).drop("__hits")
    tf = tf.groupBy(*tf.columns).agg(F.count("*").alias("tf"))
    return search(tf, stats, query, key, F.col("__keep") if keep is not None else None, top)


def evidence(chunked: DataFrame, files: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """JN-13: chunks of the scopes whose file is evidence (path, content_hash, omission), with the file's hash."""
    return chunked.where(F.col("scope").isin(*scopes)).join(files.where("omission IS NULL").select("path", "content_hash"), "path")


def chunks_refreshed(docs: DataFrame, previous: DataFrame | None) -> DataFrame:
    """TX-3: chunks with terms of docs (path, scope, content_hash, text); those of the same path, scope and hash are
    taken from the previous snapshot, unread."""
    key = ["path", "scope", "content_hash"]

    def made(some: DataFrame) -> DataFrame:
        hashes = some.select(*key)
        return chunks(some).join(hashes, ["path", "scope"]).withColumn("terms", words(F.concat_ws(" ", "path", "heading", "body")))

    if previous is None:
        return made(docs)
    kept = previous.join(docs.select(*key), key, "left_semi")
    return kept.unionByName(made(docs.join(previous.select(*key).distinct(), key, "left_anti")))


def round_robin(rows: DataFrame, bucket: str, order: list) -> DataFrame:
    """WN-2: buckets take turns, in the order of their first row; position counts from 1."""
    ranked = rows.withColumn("__rank", F.row_number().over(W.orderBy(*order)))
    ranked = ranked.withColumn("__pass", F.row_number().over(W.partitionBy(bucket).orderBy("__rank"))).withColumn("__first", F.min("__rank").over(W.partitionBy(bucket)))
    return ranked.withColumn("position", F.row_number().over(W.orderBy("__pass", "__first"))).drop("__rank", "__pass", "__first")


def exact_tier(symbols: DataFrame, chunked: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TX-5: (items, missing) of wanted (target): by qualified name, name or file, else the chunks of that path."""
    t = wanted.select("target")
    tiers = [symbols.join(t, F.col(c) == F.col("target")).select("target", "node_key", "file_path", "start_line", "end_line", F.lit(i).alias("tier")) for i, c in enumerate(("qualified_name", "name", "file_path"))]
    found = tiers[0].union(tiers[1]).union(tiers[2])
    found = found.withColumn("__best", F.min("tier").over(W.partitionBy("target"))).where("tier = __best").drop("__best")
    rest = t.join(found.select("target").distinct(), "target", "left_anti")
    parts = chunked.join(rest, F.col("path") == F.col("target")).select("target", F.col("path").alias("node_key"), F.col("path").alias("file_path"), "start_line", "end_line", F.lit(3).alias("tier"))
    return found.union(parts), rest.join(parts.select("target").distinct(), "target", "left_anti")


def merged(exact: DataFrame, lexical: DataFrame, most: int = TOP) -> DataFrame:
    """TX-6: exact items first, then lexical ones in position order that no exact span of the file contains."""
    e = exact.select(F.col("file_path").alias("__f"), F.col("start_line").alias("__a"), F.col("end_line").alias("__b"))
    free = lexical.join(e, (F.col("path") == F.col("__f")) & (F.col("start_line") >= F.col("__a")) & (F.col("end_line") <= F.col("__b")), "left_anti")
    cols = ["path", "start_line", "end_line", "reason", "place"]
    a = exact.select(F.col("file_path").alias("path"), "start_line", "end_line", F.lit("exact").alias("reason"), F.lit(0).alias("place")).distinct()
    b = free.select("path", "start_line", "end_line", F.lit("lexical").alias("reason"), F.col("position").alias("place"))
    return a.select(*cols).union(b.select(*cols)).orderBy("place", "path", "start_line").limit(most)


def instruction_files(paths: DataFrame, files: DataFrame, names: tuple[str, ...] = ("AGENTS.md", "CLAUDE.md", "CONTRIBUTING.md"), most: int = 20) -> list[str]:
    """TX-9: files of those names in folders above the paths, the first `most` in order."""
    up = paths.select(F.explode(ancestors("path")).alias("a")).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    wanted = up.select(F.when(F.col("a") == "", F.col("name")).otherwise(F.concat_ws("/", "a", "name")).alias("path"))
    return [r["path"] for r in files.join(wanted, "path", "left_semi").select("path").distinct().orderBy("path").limit(most).collect()]


def condensed(lines: DataFrame, key: str, number: str, text: str, pattern: str, before: int = 1, after: int = 2, first: int = 20, last: int = 10) -> DataFrame:
    """EXT-18: lines near a match, and each text's first and last ones."""
    w = W.partitionBy(key).orderBy(number)
    hit = F.col(text).rlike(pattern).cast("int")
    near = F.max(hit).over(w.rowsBetween(-after, before)) == 1
    rank, count = F.row_number().over(w), F.count("*").over(W.partitionBy(key))
    return lines.withColumn("__keep", near | (rank <= first) | (rank > count - last)).where("__keep").drop("__keep")


def read_range(texts: DataFrame, path: str, first: int, last: int, expected_hash: str) -> DataFrame:
    """TX-8: lines first to last of one file as they are, with their ends; no row if the hash is another."""
    rows = texts.where((F.col("path") == path) & (F.col("content_hash") == expected_hash))
    lines = F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    return rows.select("path", "content_hash", F.array_join(F.slice(lines, first, max(0, last - first + 1)), "").alias("text"))


def reduced_output(log: str, kind: str, exit_code: int | None) -> str:
    """EXT-17: of a failed pytest or tsc log the failures; anything else as it is."""
    lines = log.splitlines()
    if kind == "pytest" and exit_code:
        starts = [i for i, x in enumerate(lines) if x.startswith("=") and ("FAILURES" in x or "ERRORS" in x)]
        if starts:
            return "\n".join(x for x in lines[starts[0] :] if not x.rstrip().endswith("%]"))
    if kind == "tsc" and exit_code:
        errors = [x for x in lines if ": error TS" in x or x.startswith("error TS")]
        if errors:
            return "\n".join(errors)
    return log
