"""A training corpus from raw documents: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exactdup, mixing, neardup, pieces, toxicity
from graphloom.llm.common import Scratch, documents, temporary
from graphloom.plans.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is predicted toxic go; the model learns from labelled rows of its input."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exactdup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near-duplicates the document with the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times, and not at all beyond a source's target."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return pieces.encoded(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: The stages train models and sample hashes, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, tmp, last = documents(spark, sf_dir), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with temporary():
            docs = tmp.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            tmp.drop(last)
        last = docs
    return docs
