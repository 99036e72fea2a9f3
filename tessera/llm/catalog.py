"""The corpus queries, one for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import attribution, chat, decontamination, divergence, interpolation, jaccard, merkle, mixing, quality, quantisation, sstable, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op1_chat(spark, _table(spark, sf_dir, "conversations"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_warc(spark, _table(spark, sf_dir, "pages"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_mix(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.op6_attribution(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op7_decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantisation.op8_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.op10_sstable(spark, _table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_divergence(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12_merkle(_table(spark, sf_dir, "documents"))


def op13_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.op13_interpolation(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_warc": op2_warc,
    "op3_mix": op3_mix,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_attribution": op6_attribution,
    "op7_decontamination": op7_decontamination,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_sstable": op10_sstable,
    "op11_divergence": op11_divergence,
    "op12_merkle": op12_merkle,
    "op13_interpolation": op13_interpolation,
}
ORACLES: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
