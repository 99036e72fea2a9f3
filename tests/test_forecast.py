"""Models a series: parts of the future, empty contexts, wrong results, averages of members."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forecast as fc
from tessera.operators.series import Series

START = datetime.datetime(2024, 1, 1)


def _table(spark, counts, first=0, target=True):
    rows = [(k, START + datetime.timedelta(days=first + i), float(10 * k + i % 3) if target else None, i) for k, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "item_id int, timestamp timestamp_ntz, target double, extra int")


def test_parts_and_missing_sides(spark):
    past, ahead = Series(_table(spark, {1: 9, 2: 2, 5: 4})), _table(spark, {1: 8, 2: 1, 3: 2}, 9, target=False)
    found = {n: {(r.item_id, r.timestamp.day): (r.target, r.quantiles) for r in fc.forecast(past, ahead, fc.seasonal_naive(3), [0.5], part=n).collect()} for n in (3, 100)}
    assert found[3] == found[100] and len(found[3]) == 11
    assert [found[3][1, 10 + i][0] for i in range(8)] == [10.0 + i % 3 for i in range(8)]
    assert found[3][2, 10] == (21.0, [21.0]) and found[3][3, 10] == (None, [None])
    short = fc.forecast(past, ahead, fc.seasonal_naive(3), [], most=2).where("item_id = 1").orderBy("timestamp").collect()
    assert [r.target for r in short] == [12.0] * 8 and short[0].quantiles == []


def test_wrong_results_raise(spark):
    past, ahead = Series(_table(spark, {1: 3})), _table(spark, {1: 2}, 3, target=False)
    for model, message in ((lambda a, b, q: [1], "dict with a target"), (lambda a, b, q: {"target": np.zeros(2)}, "level 0.5"), (lambda a, b, q: {"target": np.zeros(3), 0.5: np.zeros(2)}, "shape")):
        with pytest.raises(Exception, match=message):
            fc.forecast(past, ahead, model, [0.5]).collect()
    with pytest.raises(ValueError, match="must be null"):
        fc.forecast(past, _table(spark, {1: 2}, 3), fc.seasonal_naive(1), [])


def test_models_see_shared_columns_alone(spark):
    past = Series(_table(spark, {1: 3}).withColumn("mine", F.lit(1)))
    ahead = _table(spark, {1: 2}, 3, target=False).withColumn("yours", F.lit(2))

    def model(a, b, q):
        assert list(a.columns) == ["timestamp", "target", "extra"] and list(b.columns) == ["step", "timestamp", "extra"]
        return {"target": b["extra"].to_numpy(dtype=float)}

    assert [r.target for r in fc.forecast(past, ahead, model, []).orderBy("timestamp").collect()] == [0.0, 1.0]


def test_averages(spark):
    schema = "item_id int, timestamp int, target double, quantiles array<double>"
    a, b = spark.createDataFrame([(1, 1, 2.0, [1.0, 3.0])], schema), spark.createDataFrame([(1, 1, 1.0, [2.0, -2.0])], schema)
    assert tuple(fc.averaged([a, b], "item_id", "timestamp").first()) == (1, 1, 1.5, [0.5, 1.5])
    scales = spark.createDataFrame([(0, 1, 0.0, 1.0), (1, 1, 10.0, 2.0)], "member int, item_id int, mean double, scale double")
    assert tuple(fc.averaged([a, b], "item_id", "timestamp", scales).first()) == (1, 1, 7.0, [4.5, 7.5])
