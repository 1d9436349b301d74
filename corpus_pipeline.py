"""A training-data pipeline: toxicity, exact dedup, near-dedup, mixing, tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchwright.llm import bpe, exact_dedup, mixing, simhash, toxicity
from sketchwright.llm.common import documents, written
from sketchwright.llm.queries import vocabulary_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the smallest doc_id."""
    return simhash.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and decoded text."""
    return bpe.tokens(docs, vocabulary_path(), keep=("doc_id", "source"), forget=True)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash", unlike),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The first stage's model is trained; no SQL expresses it. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
