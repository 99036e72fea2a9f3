"""Queries of distributions, periods and iterative procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import distributions as ds
from tessera.operators import loops, metrics, periods
from tessera.sources.tables import table

BORDERS = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0]
LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _bars(spark, sf_dir):
    """event_id, mass over five buckets, y in their range."""
    e = table(spark, sf_dir, "events")
    raw = F.array(*((F.pmod(F.col("event_id") * (7 + i), F.lit(11)) + 1).cast("double") for i in range(5)))
    return e.select("event_id", metrics.normalised(raw).alias("mass"), F.pmod(F.col("event_id") * 13, F.lit(160)).cast("double").alias("y")).withColumn("y", F.col("y") / 10)


_B = "(SELECT event_id, list_transform(r, lambda v: v / list_sum(r)) AS p, (event_id * 13 % 160) / 10.0 AS y, [0.0, 1.0, 2.0, 4.0, 8.0]::DOUBLE[] AS lo, [1.0, 2.0, 4.0, 8.0, 16.0]::DOUBLE[] AS hi FROM (SELECT event_id, list_transform(range(5), lambda i: (event_id * (7 + i) % 11 + 1)::DOUBLE) AS r FROM events))"


def _quantiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = F.array(*((F.lit(float(i * 3)) + F.pmod(F.col("event_id") * (3 + i), F.lit(7))) for i in range(5)))
    return e.select("event_id", q.alias("q"), F.pmod(F.col("event_id"), F.lit(20)).cast("double").alias("y"))


_Q = "(SELECT event_id, list_transform(range(5), lambda i: (i * 3 + event_id * (3 + i) % 7)::DOUBLE) AS q, (event_id % 20)::DOUBLE AS y, [0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[] AS a FROM events)"


def bar_moments(spark, sf_dir):
    m = F.col("mass")
    return _bars(spark, sf_dir).select("event_id", F.round(ds.bar_mean(m, BORDERS), 7).alias("mean"), F.round(ds.bar_variance(m, BORDERS), 7).alias("variance"))


def bar_cdf(spark, sf_dir):
    return _bars(spark, sf_dir).select("event_id", F.round(ds.bar_cdf(F.col("mass"), BORDERS, F.col("y")), 7).alias("below"))


def bar_quantile(spark, sf_dir):
    return _bars(spark, sf_dir).select("event_id", F.round(ds.bar_quantile(F.col("mass"), BORDERS, F.lit(0.7)), 7).alias("q70"))


def bar_mode(spark, sf_dir):
    return _bars(spark, sf_dir).select("event_id", ds.bar_mode(F.col("mass"), BORDERS).alias("mode"))


def bar_nll(spark, sf_dir):
    return _bars(spark, sf_dir).agg(F.round(F.avg(ds.bar_nll(F.col("mass"), BORDERS, F.col("y"))), 7).alias("nll"))


def bar_utilities(spark, sf_dir):
    m = F.col("mass")
    return _bars(spark, sf_dir).select("event_id", F.round(ds.expected_improvement(m, BORDERS, 3.0), 7).alias("improvement"), F.round(ds.exceedance(m, BORDERS, 3.0), 7).alias("exceeds"))


def bar_rebinned(spark, sf_dir):
    b = ds.rebinned(F.col("mass"), BORDERS, [0.0, 3.0, 10.0, 16.0])
    return _bars(spark, sf_dir).select("event_id", *(F.round(F.get(b, F.lit(i)), 7).alias(f"b{i}") for i in range(3)))


def quantile_pinball(spark, sf_dir):
    return _quantiles(spark, sf_dir).select("event_id", F.round(ds.pinball(F.col("q"), LEVELS, F.col("y")), 7).alias("loss"))


def quantile_crps(spark, sf_dir):
    return _quantiles(spark, sf_dir).agg(F.round(F.avg(ds.crps(F.col("q"), LEVELS, F.col("y"))), 7).alias("crps"))


def quantile_monotone(spark, sf_dir):
    q = ds.monotone(F.col("q"))
    return _quantiles(spark, sf_dir).select("event_id", *(F.get(q, F.lit(i)).alias(f"q{i}") for i in range(5)))


def quantile_icdf(spark, sf_dir):
    q = ds.monotone(F.col("q"))
    return _quantiles(spark, sf_dir).select("event_id", *(F.round(ds.quantile_at(q, LEVELS, a), 7).alias(n) for n, a in (("q05", 0.05), ("q40", 0.4), ("q97", 0.97))))


def isotonic(spark, sf_dir):
    return _quantiles(spark, sf_dir).select("event_id", F.transform(ds.isotonic("q"), lambda v: F.round(v, 7)).alias("fit")).select("event_id", *(F.get("fit", F.lit(i)).alias(f"f{i}") for i in range(5)))


def ts_periodicity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("wave", F.sin(2 * F.pi() * F.col("event_id") / 12) * 10 + F.col("value") / 50).withColumn("g", F.col("event_id") % 1)
    return periods.periods(e, "g", "event_id", "wave", 2)


def ts_periodic_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("wave", F.sin(2 * F.pi() * F.col("event_id") / 12)).select((F.col("event_id") % 1).alias("g"), "event_id", "wave")
    return periods.periodic_features(e, "g", "event_id", "wave", 1)


def _probs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", metrics.softmax(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 6)).alias("p"))


def em_prior(spark, sf_dir):
    found = loops.em_prior(_probs(spark, sf_dir), "p", [1 / 3] * 3)
    return spark.createDataFrame([(i, round(p, 6)) for i, p in enumerate(found)], "class int, prior double")


def two_gaussian_fit(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"))
    found = loops.two_gaussians(s, "x", 0.5, 10)
    return spark.createDataFrame([tuple(round(v, 6) for v in found)], "low double, low_spread double, high double, high_spread double")


def mass_projection(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("vec_id", (F.element_at("embedding", 1).cast("double") + 0.5).alias("w"))
    t = loops.mass_threshold(s, "w", 40.0)
    return s.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") - F.lit(t))), 6).alias("w"))


def greedy_growth(spark, sf_dir):
    """From every fourth row on, 60 of all other rows."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    return loops.greedy_growth(rows.where("row_id % 4 = 0"), rows, loops.knn_scorer(), 60, how="frac", amount=0.5)


def checkpoint_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("event_id").alias("step"), F.round("value", 0).alias("loss"))
    return loops.best_checkpoint(e, "run").select("run", "step", "loss")


QUERIES = {f.__name__: f for f in (bar_moments, bar_cdf, bar_quantile, bar_mode, bar_nll, bar_utilities, bar_rebinned, quantile_pinball, quantile_crps, quantile_monotone, quantile_icdf, isotonic, ts_periodicity, ts_periodic_features, em_prior, two_gaussian_fit, mass_projection, greedy_growth, checkpoint_choice)}
_SUM = "list_sum(list_transform(range(1, {n}), lambda i: {e}))"


def _s(e, n=6):
    return _SUM.format(n=n, e=e)


def _cdf(y):
    return _s(f"p[i] * greatest(0, least(1, ({y} - lo[i]) / (hi[i] - lo[i])))")


_MONO = "list_transform(range(1, 6), lambda i: list_max(q[1:i]))"
_LOSS = "greatest(a[i] * (y - q[i]), (a[i] - 1) * (y - q[i]))"
ORACLES = {
    "bar_moments": f"SELECT event_id, round({_s('p[i] * (lo[i] + hi[i]) / 2')}, 7) AS mean, round({_s('p[i] * (lo[i] * lo[i] + lo[i] * hi[i] + hi[i] * hi[i]) / 3')} - pow({_s('p[i] * (lo[i] + hi[i]) / 2')}, 2), 7) AS variance FROM {_B}",
    "bar_cdf": f"SELECT event_id, round({_cdf('y')}, 7) AS below FROM {_B}",
    "bar_quantile": f"SELECT event_id, round(lo[k] + (hi[k] - lo[k]) * (0.7 - coalesce(list_sum(p[1:k - 1]), 0)) / p[k], 7) AS q70 FROM (SELECT *, list_filter(range(1, 6), lambda i: list_sum(p[1:i]) >= 0.7 - 1e-12)[1] AS k FROM {_B})",
    "bar_mode": f"SELECT event_id, (lo[k] + hi[k]) / 2 AS mode FROM (SELECT *, list_position(d, list_max(d)) AS k FROM (SELECT *, list_transform(range(1, 6), lambda i: p[i] / (hi[i] - lo[i])) AS d FROM {_B}))",
    "bar_nll": f"SELECT round(avg(-ln(greatest(p[k] / (hi[k] - lo[k]), 1e-12))), 7) AS nll FROM (SELECT *, least(5, len(list_filter(lo, lambda v: v <= y))) AS k FROM {_B})",
    "bar_utilities": f"SELECT event_id, round({_s('p[i] * CASE WHEN hi[i] > 3 THEN (pow(hi[i] - 3, 2) - pow(greatest(lo[i], 3) - 3, 2)) / (2 * (hi[i] - lo[i])) ELSE 0 END')}, 7) AS improvement, round(1 - {_cdf('3.0')}, 7) AS exceeds FROM {_B}",
    "bar_rebinned": f"SELECT event_id, round({_cdf('3.0')}, 7) AS b0, round({_cdf('10.0')} - {_cdf('3.0')}, 7) AS b1, round(1 - {_cdf('10.0')}, 7) AS b2 FROM {_B}",
    "quantile_pinball": f"SELECT event_id, round({_s(_LOSS)} / 5, 7) AS loss FROM {_Q}",
    "quantile_crps": f"SELECT round(avg(2 * {_s(f'{_LOSS} * [0.075, 0.2, 0.25, 0.2, 0.075][i]')}), 7) AS crps FROM {_Q}",
    "quantile_monotone": f"SELECT event_id, {', '.join(f'm[{i + 1}] AS q{i}' for i in range(5))} FROM (SELECT event_id, {_MONO} AS m FROM {_Q})",
    "quantile_icdf": f"SELECT event_id, round(m[1] + (m[2] - m[1]) / ln(0.25 / 0.1) * ln(0.05 / 0.1), 7) AS q05, round(m[2] + (m[3] - m[2]) * 0.15 / 0.25, 7) AS q40, round(m[5] + (m[5] - m[4]) / ln(0.25 / 0.1) * ln(0.1 / 0.03), 7) AS q97 FROM (SELECT event_id, {_MONO} AS m FROM {_Q})",
    # the isotonic fit by its minimax form
    "isotonic": f"SELECT event_id, {', '.join(f'round(f[{i + 1}], 7) AS f{i}' for i in range(5))} FROM (SELECT event_id, list_transform(range(1, 6), lambda i: list_max(list_transform(range(1, i + 1), lambda s: list_min(list_transform(range(i, 6), lambda t: list_avg(q[s:t])))))) AS f FROM {_Q})",
    # one row a round, until the shares move by less than the tolerance
    "em_prior": "WITH RECURSIVE q AS (SELECT list_transform(e, lambda v: v / list_sum(e)) AS p FROM (SELECT list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM (SELECT list_transform(embedding[1:3], lambda v: v::DOUBLE * 6) AS x FROM embeddings))), s AS (SELECT 0 AS round, 1 / 3.0::DOUBLE AS a, 1 / 3.0::DOUBLE AS b, 1 / 3.0::DOUBLE AS c, 1.0::DOUBLE AS moved UNION ALL SELECT round + 1, na, nb, nc, greatest(abs(na - a), abs(nb - b), abs(nc - c)) FROM (SELECT round, a, b, c, avg(p[1] * a / (p[1] * a + p[2] * b + p[3] * c)) AS na, avg(p[2] * b / (p[1] * a + p[2] * b + p[3] * c)) AS nb, avg(p[3] * c / (p[1] * a + p[2] * b + p[3] * c)) AS nc FROM s, q WHERE moved >= 1e-6 AND round < 100 GROUP BY ALL)) SELECT unnest([0, 1, 2])::INT AS class, unnest([round(a, 6), round(b, 6), round(c, 6)]) AS prior FROM (SELECT * FROM s ORDER BY round DESC LIMIT 1)",
    "two_gaussian_fit": "WITH RECURSIVE q AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings), s AS (SELECT 0 AS round, quantile_cont(x, 0.25) AS m0, greatest(stddev_pop(x), 1e-6) AS s0, quantile_cont(x, 0.75) AS m1, greatest(stddev_pop(x), 1e-6) AS s1 FROM q UNION ALL SELECT round + 1, x1 / n, greatest(sqrt(greatest(x2 / n - pow(x1 / n, 2), 0)), 1e-6), (t1 - x1) / (k - n), greatest(sqrt(greatest((t2 - x2) / (k - n) - pow((t1 - x1) / (k - n), 2), 0)), 1e-6) FROM (SELECT round, sum(g) AS n, sum(g * x) AS x1, sum(g * x * x) AS x2, count(*) AS k, sum(x) AS t1, sum(x * x) AS t2 FROM (SELECT round, m0, s0, m1, s1, x, 0.5 / s0 * exp(-pow((x - m0) / s0, 2) / 2) / (0.5 / s0 * exp(-pow((x - m0) / s0, 2) / 2) + 0.5 / s1 * exp(-pow((x - m1) / s1, 2) / 2) + 1e-300) AS g FROM s, q WHERE round < 10) GROUP BY round, m0, s0, m1, s1)) SELECT round(m0, 6) AS low, round(s0, 6) AS low_spread, round(m1, 6) AS high, round(s1, 6) AS high_spread FROM s WHERE round = 10",
    # the sum of clipped weights is linear between the places where a weight begins or ends to be clipped
    "mass_projection": "WITH q AS (SELECT vec_id, embedding[1]::DOUBLE + 0.5 AS w FROM embeddings), b AS (SELECT w AS t FROM q UNION SELECT w - 1 FROM q), f AS (SELECT t, sum(greatest(0, least(1, w - t))) AS s FROM b, q GROUP BY t), g AS (SELECT t, s, lead(t) OVER (ORDER BY t) AS t2, lead(s) OVER (ORDER BY t) AS s2 FROM f), h AS (SELECT min(t + CASE WHEN s > s2 THEN (s - 40) / (s - s2) * (t2 - t) ELSE 0 END) AS t FROM g WHERE s >= 40 AND s2 < 40) SELECT vec_id, round(greatest(0, least(1, w - h.t)), 6) AS w FROM q, h",
    "checkpoint_choice": "SELECT run, step, loss FROM (SELECT user_id % 20 AS run, event_id AS step, round(value, 0) AS loss, row_number() OVER (PARTITION BY user_id % 20 ORDER BY round(value, 0), event_id) AS r FROM events) WHERE r = 1",
}
