"""Batches on disk: round trip, ranks, commit and abort."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import batches as bt


def _rows(spark):
    rows = [(b, i, [0.0, float(b), 0.0, float(i)] if i else None, i % 2) for b in range(7) for i in range(3)]
    return spark.createDataFrame(rows, "batch int, row int, x array<double>, y int")


def test_round_trip_by_ranks(spark, tmp_path):
    df, path = _rows(spark), f"{tmp_path}/prior"
    bt.save_batches(df, path, "batch", "x", "y")
    assert sorted(os.listdir(path)) == ["metadata", "rows"] and not [n for n in os.listdir(tmp_path) if "staged" in n]
    parts = [bt.load_batches(spark, path, "batch", "x", r, 3).select("batch", "row", "x", "y").collect() for r in range(3)]
    assert [sorted({r.batch for r in p}) for p in parts] == [[0, 3], [1, 4], [2, 5]]  # batch 6 doesn't fill a round
    every = bt.load_batches(spark, path, "batch", "x").select("batch", "row", "x", "y")
    assert sorted(map(str, every.collect())) == sorted(map(str, df.collect()))
    meta = {r.batch: r for r in spark.read.json(f"{path}/metadata").collect()}
    assert len(meta) == 7 and meta[2].n_rows == 3 and meta[2].width == 4 and meta[2].entries == 4 and meta[0].entries == 2
    with pytest.raises(FileExistsError):
        bt.save_batches(df, path, "batch", "x", "y")
    with pytest.raises(ValueError, match="rank 3"):
        bt.load_batches(spark, path, "batch", "x", 3, 3)


def test_abort_leaves_nothing(spark, tmp_path):
    with pytest.raises(RuntimeError):
        with bt.staged(spark, f"{tmp_path}/prior") as stage:
            _rows(spark).write.parquet(f"{stage}/rows")
            raise RuntimeError
    assert os.listdir(tmp_path) == []


def test_sparse_edges(spark):
    df = spark.createDataFrame([(1, []), (2, [0.0, 0.0]), (3, [None, 2.0]), (4, None)], "id int, x array<double>")
    out = df.select("id", bt.sparse(F.col("x")).alias("s"), bt.dense(bt.sparse(F.col("x"))).alias("y")).orderBy("id").collect()
    assert [r.y for r in out] == [[], [0.0, 0.0], [None, 2.0], None] and out[1].s.places == [] and out[1].s.width == 2
