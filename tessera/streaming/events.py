"""Structured streaming over events: windowed resampling with a watermark, and the last value of each series kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: object, files: int = 1) -> DataFrame:
    """A Parquet folder as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def resampled(events: DataFrame, item: str, time: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Per item and window: n, mean and sum; rows later than the watermark are dropped by Spark."""
    t = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = t.groupBy(F.window("__t", width), item).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    return out.select(item, F.col("window.start").alias("start"), "n", "mean", "sum")


def forward_filled(events: DataFrame, item: str, value: str) -> DataFrame:
    """Each batch's rows per item, in order of their time column `ts`, with the last value seen so far in any batch where a value is missing."""

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, v in zip(rows["ts"], rows[value]):
            last = v if pd.notna(v) else last
            out.append((key[0], ts, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[item, "ts", value]).astype({value: "float64"})

    kinds = dict(events.dtypes)
    return events.select(item, "ts", value).groupBy(item).applyInPandasWithState(fill, f"{item} {kinds[item]}, ts {kinds['ts']}, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)
