"""Batches of synthetic tables on any file system of the session: sparse rows and a line of metadata a batch, written in two phases and read by ranks.

A writer stages rows and metadata beside the target; commit renames the stage, abort deletes
it, so readers see whole sets of batches alone. Batches go round the ranks of a reader; the last
ones that don't fill a round are dropped, so all ranks have as many.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sparse(values: Column) -> Column:
    """The places (from 0) and values of an array's entries other than 0, and its width; null stays null. Null entries are kept."""
    pairs = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"].isNull() | (x["v"] != 0))
    found = F.struct(F.transform(pairs, lambda x: x["i"]).alias("places"), F.transform(pairs, lambda x: x["v"]).alias("values"), F.size(values).alias("width"))
    return F.when(values.isNotNull(), found)


def dense(packed: Column) -> Column:
    """The array that sparse() packed."""
    places = F.sequence(F.lit(1), packed["width"])
    at = lambda i: F.array_position(packed["places"], i - 1)
    full = F.transform(F.when(packed["width"] > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.when(at(i) > 0, F.get(packed["values"], at(i).cast("int") - 1)).otherwise(0.0))
    return F.when(packed.isNotNull(), full)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to that becomes `path` at the end, which must not exist; it is deleted if anything raises."""
    target, fs = _files(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        yield stage
        if not fs.rename(_files(spark, stage)[0], target):
            raise OSError(f"{stage} can't become {path}")
    except BaseException:
        fs.delete(_files(spark, stage)[0], True)
        raise


def metadata(df: DataFrame, batch: str, features: str, label: str) -> DataFrame:
    """Per batch its rows, the width of its features, the entries other than 0 and its distinct labels."""
    packed = sparse(F.col(features))
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(features)).alias("width"), F.sum(F.size(packed["places"])).alias("entries"), F.count_distinct(label).alias("labels"))


def save_batches(df: DataFrame, path: str, batch: str, features: str, label: str) -> None:
    """The rows of df, features packed, in a folder a batch, and their metadata as JSON."""
    with staged(df.sparkSession, path) as stage:
        df.withColumn(features, sparse(F.col(features))).repartition(batch).write.partitionBy(batch).parquet(f"{stage}/rows")
        metadata(df, batch, features, label).coalesce(1).write.json(f"{stage}/metadata")  # a row a batch


def assigned(df: DataFrame, batch: str, rank: int, world: int, batches: int) -> DataFrame:
    """The rows of the batches of one rank of `world`: batch 0, 1, ... in turn, as far as rounds are full."""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} isn't below {world}")
    return df.where((F.pmod(F.col(batch), F.lit(world)) == rank) & F.col(batch).between(0, batches // world * world - 1))


def load_batches(spark: SparkSession, path: str, batch: str, features: str, rank: int = 0, world: int = 1) -> DataFrame:
    """The rows of a rank's batches with dense features. Batches that aren't asked for aren't read: their folders are pruned."""
    rows = spark.read.parquet(f"{path}/rows")
    count = spark.read.json(f"{path}/metadata").agg(F.max(batch)).first()[0]
    return assigned(rows, batch, rank, world, 0 if count is None else count + 1).withColumn(features, dense(F.col(features)))
