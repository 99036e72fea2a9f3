"""The mixed encoding, fitted powers and noisy quantiles against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import steps as st
from tessera.operators import transforms as t
from tessera.operators.scaler import MixedScaler


def test_round_trip_of_a_mixed_table(spark):
    rows = [(1.0, "b", 5), (3.0, "a", 7), (None, None, 5), (2.0, "c", None)]
    df = spark.createDataFrame(rows, "x double, kind string, code int")
    for how in ("min_max", "standard", "none"):
        s = MixedScaler.fit(df, ["x", "kind", "code"], ["kind", "code"], how)
        back = df.select(s.encoded().alias("e")).select(*(c.alias(n) for n, c in s.decoded(F.col("e")).items()))
        assert [tuple(r) for r in back.collect()] == rows
    assert s.size == 6 and s.mask({"x": True, "kind": False, "code": True}) == [True, False, False, False, True, True]
    soft = s.decoded(F.array(*map(F.lit, [0.5, 0.2, 0.3, 0.3, 0.1, 0.0])))
    assert tuple(spark.range(1).select(*soft.values()).first()) == (0.5, "b", 5)
    with pytest.raises(ValueError, match="more than 2"):
        MixedScaler.fit(df, ["kind"], ["kind"], most=2)
    with pytest.raises(ValueError, match="less than"):
        MixedScaler((), 1.0, 1.0)


def _best(likelihood, low, high):
    """A fine search in numpy."""
    grid = np.linspace(low, high, 2001)
    for _ in range(3):
        k = int(np.argmax([likelihood(p) for p in grid]))
        grid = np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], 201)
    return grid[100]


def test_powers_are_the_optimum(spark):
    r = np.random.default_rng(1)
    x, y = np.exp(r.normal(size=800)), r.normal(size=800) ** 3
    df = spark.createDataFrame([(float(a), float(b), 4.0) for a, b in zip(x, y)] + [(None, None, 4.0)], "x double, y double, k double")

    def yj(p, v):
        up = np.log1p(np.abs(v)) if abs(p) < 1e-12 else ((np.abs(v) + 1) ** p - 1) / p
        down = -np.log1p(np.abs(v)) if abs(p - 2) < 1e-12 else -((np.abs(v) + 1) ** (2 - p) - 1) / (2 - p)
        z = np.where(v >= 0, up, down)
        return -len(v) / 2 * np.log(z.var()) + (p - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    found = t.yeo_johnson_powers(df, ["x", "y", "k"])
    assert abs(found["x"] - _best(lambda p: yj(p, x), -2, 4)) < 1e-4 and abs(found["y"] - _best(lambda p: yj(p, y), -2, 4)) < 1e-4 and found["k"] == 1.0
    bc = lambda p: -len(x) / 2 * np.log(((x**p - 1) / p if abs(p) > 1e-12 else np.log(x)).var()) + (p - 1) * np.log(x).sum()
    assert abs(t.box_cox_powers(df, ["x"])["x"] - _best(bc, -2, 4)) < 1e-4


def test_box_cox_preset(spark):
    """Scaled into 0.1 to 1, raised to the fitted power, standardised; later values are drawn into the range."""
    x = np.exp(np.random.default_rng(2).normal(size=500))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    f = st.PRESETS["power_box"](df, ["x"])
    m = 0.1 + 0.9 * (x - x.min()) / (x.max() - x.min())
    p = t.box_cox_powers(spark.createDataFrame([(float(v),) for v in m], "x double"), ["x"])["x"]
    z = (m**p - 1) / p
    out = np.array([r.x for r in f.transform(df).orderBy("id").collect()])
    assert np.allclose(out, (z - z.mean()) / z.std(), atol=1e-6)
    far = f.transform(spark.createDataFrame([(1, 1e9), (2, -1e9)], "id long, x double")).orderBy("id").collect()
    assert abs(far[0].x - out.max()) < 1e-9 and abs(far[1].x - out.min()) < 1e-9


def test_noisy_quantiles(spark):
    x = np.random.default_rng(3).integers(0, 6, 900).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    f = st.noisy_quantiles(df, ["x"], "id", normal=False, noise=1e-2)
    q = np.array(f.state["x"])
    assert len(q) == 30 and np.allclose(q, np.percentile(x, np.linspace(0, 100, 30)), atol=0.05) and len(set(q)) == 30
    assert np.allclose(f.state["x"], st.noisy_quantiles(df.repartition(7), ["x"], "id", normal=False, noise=1e-2).state["x"])
    plain = st.noisy_quantiles(df, ["x"], "id", noise=0.0, normal=False)
    assert np.allclose(plain.state["x"], np.percentile(x, np.linspace(0, 100, 30)))
