"""Distributions with tails on small cases: round trips, continuity, moments by numeric integration, repair of borders."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tails as tl

LEVELS = [0.02 * i for i in range(1, 50)]


@pytest.mark.parametrize("pareto", [False, True])
def test_round_trip_and_joints(spark, pareto):
    r = np.random.default_rng(1)
    rows = [(k, sorted(map(float, v))) for k, v in enumerate([r.normal(size=49), r.standard_cauchy(size=49), np.exp(r.normal(size=49)), np.linspace(0, 1, 49)])]
    rows += [(8, rows[0][1][::-1]), (9, [1.0] * 49)]
    df = tl.with_tails(spark.createDataFrame(rows, "id int, q array<double>"), "q", LEVELS, pareto=pareto)
    asked = [1e-4, 0.01, 0.02, 0.3, 0.5, 0.981, 0.999]
    t = F.col("tails")
    out = {x.id: x for x in df.select("id", *(tl.below(t, LEVELS, tl.inverse(t, LEVELS, F.lit(a))).alias(f"b{i}") for i, a in enumerate(asked)), *((tl.inverse(t, LEVELS, F.lit(a + 1e-9)) - tl.inverse(t, LEVELS, F.lit(a - 1e-9))).alias(f"j{i}") for i, a in enumerate((LEVELS[0], LEVELS[-1])))).collect()}
    for k in (0, 1, 2, 3, 8):
        # the cap of exponents bends tails of a negative shape before their end
        assert all(abs(out[k][f"b{i}"] - a) < 1e-6 for i, a in enumerate(asked) if not pareto or a > 1e-3)
        assert abs(out[k].j0) < 1e-4 and abs(out[k].j1) < 1e-4
    assert [out[0][f"b{i}"] for i in range(7)] == [out[8][f"b{i}"] for i in range(7)]
    assert out[9].b3 >= 0.02


def test_density_is_slope_of_distribution(spark):
    rows = [(0, [float(x) for x in np.sort(np.random.default_rng(2).normal(size=49))])]
    df = tl.with_tails(spark.createDataFrame(rows, "id int, q array<double>"), "q", LEVELS)
    t, ys = F.col("tails"), [-4.0, -0.5, 0.1, 3.7]
    out = df.select(*(((tl.below(t, LEVELS, F.lit(y + 1e-5)) - tl.below(t, LEVELS, F.lit(y - 1e-5))) / 2e-5).alias(f"d{i}") for i, y in enumerate(ys)), *(F.exp(tl.log_density(t, LEVELS, F.lit(y))).alias(f"e{i}") for i, y in enumerate(ys))).first()
    assert all(abs(out[f"d{i}"] - out[f"e{i}"]) < 1e-4 for i in range(4))


def test_draws_follow_the_distribution(spark):
    q = [float(v) for v in np.quantile(np.random.default_rng(3).exponential(size=20_000), LEVELS)]
    df = tl.with_tails(spark.range(4000).withColumn("q", F.array(*map(F.lit, q))), "q", LEVELS)
    x = [r[0] for r in df.select(tl.drawn(F.col("tails"), LEVELS, 1, "t", "id")).collect()]
    assert abs(np.mean(x) - 1) < 0.06 and abs(np.median(x) - math.log(2)) < 0.05
    again = df.repartition(5).select("id", tl.drawn(F.col("tails"), LEVELS, 1, "t", "id").alias("x")).orderBy("id").collect()
    assert [r.x for r in again] == x


def test_nulls_and_wrong_levels(spark):
    rows = [(0, None), (1, [None] + [1.0] * 48), (2, [float("nan")] * 49)]
    df = tl.with_tails(spark.createDataFrame(rows, "id int, q array<double>"), "q", LEVELS, pareto=True)
    assert [r[0] for r in df.select(tl.below(F.col("tails"), LEVELS, F.lit(0.5))).collect()] == [None] * 3
    with pytest.raises(ValueError, match="ascend"):
        tl.with_tails(df, "q", [0.5, 0.5])


def test_open_bars(spark):
    b = tl.OpenBars((0.0, 1.0, 2.0, 4.0))
    m = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    xs = np.linspace(-12, 20, 6401)
    rows = spark.createDataFrame([(float(x),) for x in xs], "y double").select("y", b.below(m, F.col("y")).alias("c"), b.nll(m, F.col("y")).alias("l"), b.inverse(m, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), b.below(m, F.col("y"))))).alias("back"), b.mean(m).alias("mean"), b.variance(m).alias("var")).orderBy("y").collect()
    y, c, p = (np.array([f(r) for r in rows]) for f in (lambda r: r.y, lambda r: r.c, lambda r: math.exp(-r.l)))
    area = lambda v: float(((v[1:] + v[:-1]) / 2 * np.diff(y)).sum())
    assert abs(area(p) - 1) < 1e-3 and abs(c[-1] - 1) < 1e-4 and (np.diff(c) >= -1e-12).all()
    assert abs(rows[0].mean - area(p * y)) < 5e-3
    assert abs(rows[0]["var"] - area(p * (y - rows[0].mean) ** 2)) < 2e-2
    inner = (c > 1e-4) & (c < 1 - 1e-4)
    assert max(abs(r.back - r.y) for r, k in zip(rows, inner) if k) < 1e-3
    assert abs(c[np.abs(y).argmin()] - 0.1) < 1e-6  # half of the first bucket's mass lies within its width
    with pytest.raises(ValueError, match="outer buckets"):
        tl.OpenBars((0.0, 0.0, 1.0))


def test_erf(spark):
    xs = [-7.0, -2.0, -0.3, 0.0, 1e-9, 0.5, 1.0, 3.0, 5.9, 50.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tl.erf(F.col("x"))).collect()]
    assert all(abs(a - math.erf(x)) < 1e-12 for a, x in zip(found, xs))


def test_erf_at_joints_and_without_a_number(spark):
    xs = [None, float("nan"), *np.linspace(-6.5, 6.5, 2001).tolist(), 0.46875, math.nextafter(0.46875, 1), -math.inf]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(tl.erf(F.col("x"))).collect()]
    assert found[0] is None and math.isnan(found[1])
    assert all(abs(a - math.erf(x)) < 1e-15 for a, x in zip(found[2:], xs[2:]))


def test_open_bars_make_their_arguments_once(spark):
    b, m = tl.OpenBars((0.0, 1.0, 2.0, 4.0)), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    drawn = b.drawn(m, 3, "bars", "id")
    for x in (drawn, b.below(m, drawn), b.nll(m, drawn), tl.erf(drawn), b.below(m, b.inverse(m, b.below(m, drawn)))):
        plan = spark.range(3).select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1


def test_probit(spark):
    ps = [1e-12, 1e-6, 0.02, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-9]
    found = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(tl.probit(F.col("p"))).collect()]
    assert all(abs(a - NormalDist().inv_cdf(p)) < 2e-8 for a, p in zip(found, ps))


def test_repaired_borders(spark):
    inf, nan = float("inf"), float("nan")
    r = tl.repaired_borders([-inf, -inf, 0.0, 1.0, 2.0, 5e4])
    assert r.borders == (-1.0, 0.0, 0.0, 1.0, 2.0, 3.0) and r.cancelled == (True, True, False, False, True) and not r.descending
    m = spark.range(1).select(r.mass(F.array(*map(F.lit, [0.1, 0.2, 0.3, 0.3, 0.1]))).alias("m"), tl.repaired_borders([nan, nan, 3.0]).mass(F.array(F.lit(0.5), F.lit(0.5))).alias("none")).first()
    assert m.m == pytest.approx([0, 0, 0.5, 0.5, 0]) and m.none is None
    turned = tl.repaired_borders([3.0, 2.0, -1.0])
    assert turned.descending and turned.borders == (-0.9, 2.0, 3.0)
    assert spark.range(1).select(turned.mass(F.array(F.lit(0.25), F.lit(0.75)))).first()[0] == [0.75, 0.25]
    assert tl.repaired_borders([1.0, 2.0, nan, nan], cancel=False).borders == (1.0, 2.0, 2.0, 4.0)
    assert tl.repaired_borders([1.0, 1.0, 2.0], cancel=False).borders == (0.9, 1.0, 2.0)
    with pytest.raises(ValueError, match="first or last"):
        tl.repaired_borders([0.0, nan, 1.0])
