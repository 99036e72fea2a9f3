"""Beam and genetic search against exhaustive search on small tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import search as se


def _pool(spark, n=9, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row long, x array<double>")


def _spread(pool, members):
    """Minus the variance of the members, so that the tightest set has the largest value."""
    rows = members.join(pool, "row")
    return rows.groupBy("candidate").agg((-sum(F.var_pop(F.get("x", F.lit(i))) for i in range(2))).alias("value"))


def test_beam_finds_the_best_set(spark):
    x, pool = _pool(spark)
    value = lambda s: x[list(s)].var(0).sum()
    best = min(combinations(range(9), 3), key=value)
    negative = lambda p, m: _spread(p, m).select("candidate", (-F.col("value")).alias("value"))
    found = se.beam_search(pool, se.centroid_losses(), 3, width=20, branches=9, values=negative)
    assert tuple(sorted(r.row for r in found.rows.collect())) == best and abs(found.value - value(best)) < 1e-9 and found.levels == 3
    assert sorted(r.step for r in found.rows.collect()) == [0, 1, 2]


def test_beam_by_path_and_draws(spark):
    x, pool = _pool(spark, 12)
    runs = [se.beam_search(p, se.centroid_losses(), 7, width=2, branches=3, step=3, seed=4) for p in (pool, pool.repartition(5))]
    sets = [sorted(map(tuple, f.rows.collect())) for f in runs]
    assert sets[0] == sets[1] and abs(runs[0].value - runs[1].value) < 1e-9
    assert len(sets[0]) == 7 and [s for _, s in sorted(sets[0], key=lambda t: t[1])] == [0, 0, 0, 1, 1, 1, 2]
    plain = se.beam_search(pool, se.centroid_losses(), 3, width=1, branches=1, step=3)
    d = ((x - x.mean(0)) ** 2).sum(1)
    assert sorted(r.row for r in plain.rows.collect()) == sorted(np.argsort(d)[:3].tolist())
    assert se.beam_search(pool.limit(0), se.centroid_losses(), 3).rows.count() == 0
    assert se.beam_search(pool.unionAll(pool).unionAll(pool.limit(1).select(F.lit(None).cast("long"), "x")), se.centroid_losses(), 99, width=1, branches=1, step=50).rows.count() == 12


def test_genetic_finds_a_good_set(spark):
    w = [3.0, -1.0, 2.0, 0.5, -2.0, 1.0, -0.5, 4.0]
    pool = spark.createDataFrame(list(enumerate(w)), "row long, w double")
    total = lambda p, m: m.join(p, "row").groupBy("candidate").agg(F.sum("w").alias("value"))
    best = max(sum(w[i] for i in c) for k in range(1, 4) for c in combinations(range(8), k))
    found = se.genetic_search(pool, total, 3, population=12, generations=3, mutation=0.15, seed=2)
    rows = [r.row for r in found.rows.collect()]
    assert 1 <= len(rows) <= 3 and abs(sum(w[i] for i in rows) - found.value) < 1e-9 and found.value >= 0.7 * best
    again = se.genetic_search(pool.repartition(3), total, 3, population=12, generations=3, mutation=0.15, seed=2)
    assert sorted(rows) == sorted(r.row for r in again.rows.collect())
    assert se.genetic_search(pool.limit(0), total, 3).rows.count() == 0
