"""The corpus pipeline: documents without toxic texts, near copies and benchmark passages, mixed to target weights and written as shards of token ids.

1. toxicity: rows predicted toxic go (operator 4).
2. near copies: one document of each component of similar texts stays (the join of operator 5, at a Jaccard similarity of 0.8 of 5-word shingles).
3. decontamination: documents that contain a benchmark item go (operator 7).
4. mixing: each document is repeated as often as the mix takes it, none to three times (operator 3).
5. token-ID output: what is left is written as sorted-string tables; the result is a row a document, read back (operator 10).

Every stage but the last returns the columns of documents. Rows with null columns, empty
texts and further columns pass through as the operators say; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard, mixing, sstable, toxicity
from tessera.llm.common import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, mixing.mix(docs))


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.op10_sstable(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("token-ID output", write_shards),
]

#: The stages train models and pack binary files, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
