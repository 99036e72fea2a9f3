"""Places, running sums and quantiles against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import ranks


def _rows(n=700, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=n), 1)
    x[: n // 3] = 0.5  # one value of a third of the rows
    return pd.DataFrame({"id": r.permutation(n), "x": x, "w": r.integers(0, 9, n)})


def test_places_and_sums(spark):
    rows = _rows()
    df = spark.createDataFrame(rows)
    found = ranks.cumulated(ranks.numbered(df, ["x", "id"], "place"), ["x", "id"], ["w"]).toPandas().sort_values(["x", "id"])
    assert found["place"].tolist() == list(range(1, len(rows) + 1))
    assert found["before_w"].tolist() == (found["w"].cumsum() - found["w"]).tolist()


def test_average_ranks(spark):
    rows = _rows()
    found = ranks.averaged(spark.createDataFrame(rows), "x", "r").toPandas().set_index("id")["r"]
    want = rows.set_index("id")["x"].rank()
    assert (found.sort_index() == want.sort_index()).all()


def test_quantiles(spark):
    rows = _rows(501)
    df = spark.createDataFrame(rows).withColumn("none", F.lit(None).cast("double"))
    levels = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    found = ranks.quantiles(df, {"x": F.col("x"), "none": F.col("none")}, levels)
    assert np.allclose(found["x"], np.quantile(rows["x"], levels)) and found["none"] == []


def test_empty(spark):
    df = spark.createDataFrame([], "id long, x double, w long")
    assert ranks.numbered(df, ["x", "id"], "place").count() == 0 and ranks.averaged(df, "x", "r").count() == 0
    assert ranks.quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": []}
