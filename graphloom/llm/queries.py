"""The operators' queries over whole tables, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exactdup, licenses, lm, media, mixing, neardup, pieces, secrets, toxicity, urlfilter
from graphloom.llm.common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urlfilter.table(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_minhash_near_dedup, op3_audio_media, op4_sentencepiece, op5_license_scan, op6_url_filter, op7_toxicity, op8_secret_scan, op9_lm_score, op10_exact_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[sid % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM p),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
o AS (SELECT *, cap::HUGEINT * share >= weight::HUGEINT * rest AS free FROM l),
f AS (SELECT rest AS l, share AS s FROM o WHERE free ORDER BY cap / weight, sid LIMIT 1),
u AS (SELECT source, source_size, sid, free, CASE WHEN free THEN (weight * f.l)::DOUBLE / f.s::DOUBLE ELSE cap::DOUBLE END AS target FROM o, f),
r AS (SELECT d.doc_id, d.size, u.source_size, u.sid, u.target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
e AS (SELECT *, epoch * source_size + before + size AS stop FROM (SELECT *, unnest(range(0, 3)) AS epoch FROM b)),
x AS (SELECT *, stop::DOUBLE / greatest(target, 1e-9) AS finish FROM e),
g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, sid, stop, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM x)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - ahead)))::BIGINT AS taken FROM g GROUP BY doc_id, size, source_size, target""",
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(doc_id, other) AS (SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op6_url_filter": rf"""
WITH e AS (SELECT * FROM (VALUES {', '.join(f"('{h}', '{p}', '{v}', {r})" for rows, r in ((urlfilter.RULES, True), (urlfilter.LISTED, False)) for h, p, v in rows)}) t(h, p, v, r)),
u AS (SELECT page_id, row_number() OVER () AS uid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
s AS (SELECT page_id, uid, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.uid, max(CASE WHEN r THEN lpad(len(h || p)::VARCHAR, 9, '0') || h || p END) AS best, max(CASE WHEN r THEN lpad(len(h || p)::VARCHAR, 9, '0') || h || p || v END) AS judged, bool_or(NOT r AND v = 'block') AS listed
  FROM s JOIN e ON (s.host = e.h OR ends_with(s.host, '.' || e.h)) AND starts_with(s.path, e.p) WHERE s.host <> '' GROUP BY s.uid)
SELECT page_id, host, path, substr(best, 10) AS rule, CASE WHEN best IS NOT NULL THEN substr(judged, len(best) + 1) WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM s LEFT JOIN m USING (uid)""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
}
