"""Training-corpus pipeline: each stage takes what the one before kept and writes what it keeps.

Toxic documents go, one document of each group of near duplicates stays, passages that occur
earlier are cut out, documents that hold a benchmark item go, and the rest is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from aliasmith.llm import bpe, decontaminate, neardup, substring, toxicity
from aliasmith.llm.kernel import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the classifier doesn't reject; null and empty texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; rows of null doc_id, text or no words stay."""
    return neardup.drop_near_duplicates(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of 50 words or more that occur earlier; rows that lose every word go."""
    return substring.drop_shared_passages(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row; all but doc_id null where the text is."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring", cut_shared_passages),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No stage but the third has SQL: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
