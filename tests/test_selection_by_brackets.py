"""Quantiles by brackets, places by halved borders and powers over counted values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranks, transforms

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.501, 0.999, 1.0]


def test_quantiles_number_no_whole_table(spark, monkeypatch):
    """As numpy has them, with ties, nulls and infinities, and without a place for every distinct value."""
    monkeypatch.setattr(ranks, "cumulated", lambda *a: pytest.fail("all values are placed"))
    rng = np.random.default_rng(4)
    x = np.where(rng.random(50_000) < 0.4, 7.0, rng.normal(size=50_000) * 10)
    df = spark.createDataFrame([(float(v), float(i % 3), float(v) if i else float("inf"), None) for i, v in enumerate(x)], "a double, b double, c double, d double")
    found = ranks.quantiles(df, {c: F.col(c) for c in "abcd"}, LEVELS)
    assert found["d"] == []
    for c, values in (("a", x), ("b", np.arange(50_000) % 3.0)):
        assert np.allclose(found[c], np.quantile(values, LEVELS), rtol=0, atol=1e-12)
    assert found["c"][-1] == float("inf") and abs(found["c"][3] - np.quantile(np.append(x[1:], np.inf), 0.5)) < 1e-12


def test_unenclosed_places_widen(spark, monkeypatch):
    asked, inner = [], ranks._at_places
    monkeypatch.setattr(ranks, "_at_places", lambda rows, brackets, places: asked.append(brackets) or inner(rows, [(1e9, 1e9)] if len(asked) < 5 else brackets, places))
    assert ranks.quantiles(spark.range(101), {"id": F.col("id")}, [0.5])["id"] == [50.0] and len(asked) == 5


def test_powers_read_the_table_once(spark):
    """Grids of powers read counted values."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    rows = spark.createDataFrame([(float(i % 40 + 1),) for i in range(4000)], "x double").mapInPandas(counted, "x double")
    assert -2 < transforms.yeo_johnson_powers(rows, ["x"])["x"] < 4
    assert reads.value == 4000
