"""Queries of distributions with tails: quantiles of prices by supplier, bars of events with open ends, repaired borders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import distributions as ds
from tessera.operators import tails as tl
from tessera.plans.models import _B, BORDERS, _bars
from tessera.sources.tables import table

LEVELS = [i / 20 for i in range(1, 20)]
ASKED = {"p01": 0.01, "p33": 0.33, "p95": 0.95, "p99": 0.99}


def _prices(spark, sf_dir, pareto):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, LEVELS))).alias("q"), F.avg("l_extendedprice").alias("mean"), F.max("l_extendedprice").alias("most"))
    return tl.with_tails(rows, "q", LEVELS, pareto=pareto)


def _functions(spark, sf_dir, pareto):
    rows, t = _prices(spark, sf_dir, pareto), F.col("tails")
    found = {name: tl.inverse(t, LEVELS, F.lit(a)) for name, a in ASKED.items()}
    back = [F.round(tl.below(t, LEVELS, x), 6).alias(f"back_{name}") for name, x in found.items()]
    joints = [F.round(tl.inverse(t, LEVELS, F.lit(a + s * 1e-12)) - tl.inverse(t, LEVELS, F.lit(a)), 3).alias(n) for n, a, s in (("left_joint", LEVELS[0], -1), ("right_joint", LEVELS[-1], 1))]
    far = [F.round(tl.below(t, LEVELS, F.col("most") + 50), 7).alias("far"), F.round(tl.log_density(t, LEVELS, F.col("most") + 50), 5).alias("far_density")]
    drawn = tl.drawn(t, LEVELS, 7, "price", "l_suppkey")
    return rows.select("l_suppkey", *(F.round(x, 5).alias(n) for n, x in found.items()), *back, *joints, *far, F.round(tl.below(t, LEVELS, F.col("mean")), 6).alias("at_mean"), F.round(tl.log_density(t, LEVELS, F.col("mean")), 5).alias("density"), F.round(drawn, 5).alias("drawn"))


def quantile_tails_exponential(spark, sf_dir):
    return _functions(spark, sf_dir, False)


def quantile_tails_pareto(spark, sf_dir):
    return _functions(spark, sf_dir, True)


def open_bars(spark, sf_dir):
    """Moments, distribution function and density of bars with half-normal ends, at values within and beyond the borders."""
    b, m = tl.OpenBars(tuple(BORDERS)), F.col("mass")
    rows = _bars(spark, sf_dir).withColumn("z", F.col("y") * 1.6 - 5)
    back = b.below(m, b.inverse(m, F.lit(0.03)))
    return rows.select("event_id", F.round(b.mean(m), 7).alias("mean"), F.round(b.variance(m), 6).alias("variance"), F.round(b.below(m, F.col("z")), 6).alias("below"), F.round(b.nll(m, F.col("z")), 6).alias("nll"), F.round(back, 5).alias("back"))


def bar_repaired(spark, sf_dir):
    """Means of bars on borders after a logarithm, which breaks the first one, and after a change of sign, which reverses them."""
    m = F.col("mass")
    logs = tl.repaired_borders([math.log(x) if x > 0 else float("-inf") for x in BORDERS])
    turned = tl.repaired_borders([-x for x in BORDERS])
    return _bars(spark, sf_dir).select("event_id", F.round(ds.bar_mean(logs.mass(m), list(logs.borders)), 7).alias("log_mean"), F.round(ds.total(logs.mass(m)), 9).alias("log_total"), F.round(ds.bar_mean(turned.mass(m), list(turned.borders)), 7).alias("turned_mean"))


QUERIES = {f.__name__: f for f in (quantile_tails_exponential, quantile_tails_pareto, open_bars, bar_repaired)}


def _tails_sql(pareto):
    """The same functions over lists; e and f are the shapes of the tails, s and t their scales."""
    reach = lambda ratio, scale, shape: f"(CASE WHEN abs({shape}) < 0.01 THEN {scale} * least(ln({ratio}), 15) ELSE {scale} / {shape} * (exp(least({shape} * least(ln({ratio}), 15), 15)) - 1) END)"
    inv = lambda a: f"(CASE WHEN {a} < 0.05 THEN q[1] - {reach(f'(0.05 / greatest({a}, 1e-6))', 's', 'e')} WHEN {a} > 0.95 THEN q[19] + {reach(f'((1 - 0.95) / greatest(1 - {a}, 1e-6))', 't', 'f')} ELSE (SELECT q[i] + ({a} - lv[i]) / (lv[i + 1] - lv[i]) * (q[i + 1] - q[i]) FROM (SELECT greatest(1, least(18, len(list_filter(lv, lambda b: b <= {a})))) AS i)) END)"
    over = lambda d, scale, shape: f"(CASE WHEN abs({shape}) < 0.01 THEN exp(-greatest({d} / {scale}, 0)) ELSE exp(greatest(-15, least(15, -ln(greatest(1 + {shape} * least(15, greatest({d} / {scale}, 0)), 1e-6)) / {shape}))) END)"
    cdf = lambda y: f"(CASE WHEN {y} < q[1] THEN least(0.05, 0.05 * {over(f'(q[1] - {y})', 's', 'e')}) WHEN {y} > q[19] THEN greatest(0.95, 1 - (1 - 0.95) * {over(f'({y} - q[19])', 't', 'f')}) WHEN {y} >= q[19] THEN 0.95 ELSE (SELECT lv[j] + greatest(0, least(1, ({y} - q[j]) / greatest(q[j + 1] - q[j], 1e-6))) * (lv[j + 1] - lv[j]) FROM (SELECT greatest(1, least(18, len(list_filter(q, lambda b: b <= {y})))) AS j)) END)"
    slope = "(CASE WHEN a < 0.05 THEN s / greatest(a, 1e-6) * (CASE WHEN abs(e) < 0.01 THEN 1 ELSE exp(least(e * least(ln(0.05 / greatest(a, 1e-6)), 15), 15)) END) WHEN a > 0.95 THEN t / greatest(1 - a, 1e-6) * (CASE WHEN abs(f) < 0.01 THEN 1 ELSE exp(least(f * least(ln((1 - 0.95) / greatest(1 - a, 1e-6)), 15), 15)) END) ELSE (SELECT (q[k + 1] - q[k]) / greatest(lv[k + 1] - lv[k], 1e-6) FROM (SELECT greatest(1, least(18, len(list_filter(lv, lambda b: b <= a)))) AS k)) END)"
    density = lambda a: f"(SELECT round(-ln(greatest(1e-6, least(1e6, {slope}))), 5) FROM (SELECT {a} AS a))"
    bend = lambda d, x, y: f"(CASE WHEN ({d}) / ({x} / {y}) > 1e-6 THEN greatest(-0.49, least(0.49, ln(greatest(({d}) / ({x} / {y}), 1e-6)) / {x})) ELSE 0 END)"
    e = bend("(q[2] - q[1]) / greatest(q[3] - q[2], 1e-6)", "ln(lv[2] / lv[1])", "ln(lv[3] / lv[2])") if pareto else "0.0"
    f = bend("(q[19] - q[18]) / greatest(q[18] - q[17], 1e-6)", "ln((1 - lv[18]) / (1 - lv[19]))", "ln((1 - lv[17]) / (1 - lv[18]))") if pareto else "0.0"
    scale = lambda values, logs: f"greatest(0.01, least(100, abs((SELECT regr_slope(v, x) FROM (SELECT unnest({values}) AS v, unnest(list_transform({logs}, lambda w: ln(w))) AS x)))))"
    u = "(('0x' || substr(md5('7|price|' || l_suppkey), 1, 8))::BIGINT / 4294967296.0)"
    names = ", ".join([*(f"round({n}, 5) AS {n}" for n in ASKED), *(f"round({cdf(n)}, 6) AS back_{n}" for n in ASKED)])
    return f"""
WITH grouped AS (
  SELECT l_suppkey, quantile_cont(l_extendedprice, {LEVELS}) AS q, avg(l_extendedprice) AS mean, max(l_extendedprice) + 50 AS beyond, {LEVELS}::DOUBLE[] AS lv, greatest(1e-6, least(1 - 1e-6, {u})) AS u FROM lineitem GROUP BY 1
), fitted AS (
  SELECT *, {scale("q[1:4]", "lv[1:4]")} AS s, {scale("q[16:19]", "list_transform(lv[16:19], lambda w: 1 - w)")} AS t, {e} AS e, {f} AS f FROM grouped
), placed AS (
  SELECT *, {", ".join(f"{inv(a)} AS {n}" for n, a in ASKED.items())}, {inv("u")} AS drawn, {cdf("beyond")} AS far, {cdf("mean")} AS near FROM fitted
)
SELECT l_suppkey, {names}, 0.0 AS left_joint, 0.0 AS right_joint, round(far, 7) AS far, {density("far")} AS far_density, round(near, 6) AS at_mean, {density("near")} AS density, round(drawn, 5) AS drawn
FROM placed
"""


_H = 1 / tl.HALF
_M = math.sqrt(2 / math.pi)


def _erf(x):
    z = f"greatest(least(abs({x}), 6.0), 1e-300)"
    return f"(sign({x}) * least(1.0, {2 / math.sqrt(math.pi)!r} * exp(-{z} * {z}) * list_sum(list_transform(range(0, 121), lambda n: exp(ln({z}) + n * ln(2 * {z} * {z}) - (lgamma(2 * n + 3.0) - (n + 1) * ln(2) - lgamma(n + 2.0)))))))"


_SIDE = [(1 - 0) * _H, (16 - 8) * _H]
_MEANS = f"[{1 - _SIDE[0] * _M!r}, 1.5, 3.0, 6.0, {8 + _SIDE[1] * _M!r}]"
_SQUARES = f"[{_SIDE[0] ** 2 * (1 - _M * _M) + (1 - _SIDE[0] * _M) ** 2!r}, {7 / 3!r}, {28 / 3!r}, {112 / 3!r}, {_SIDE[1] ** 2 * (1 - _M * _M) + (8 + _SIDE[1] * _M) ** 2!r}]"
_DOT = "list_sum(list_transform(range(1, 6), lambda i: p[i] * {}[i]))"
ORACLES = {
    "quantile_tails_exponential": _tails_sql(False),
    "quantile_tails_pareto": _tails_sql(True),
    "open_bars": f"""
WITH rows AS (SELECT event_id, p, y * 1.6 - 5 AS z FROM {_B}), parts AS (
  SELECT *, CASE WHEN z >= 1 THEN 1.0 ELSE 1 - {_erf(f"((1 - z) / {_SIDE[0] * math.sqrt(2)!r})")} END AS a, CASE WHEN z <= 8 THEN 0.0 ELSE {_erf(f"((z - 8) / {_SIDE[1] * math.sqrt(2)!r})")} END AS b FROM rows
)
SELECT event_id, round({_DOT.format(_MEANS)}, 7) AS mean, round({_DOT.format(_SQUARES)} - pow({_DOT.format(_MEANS)}, 2), 6) AS variance,
  round(p[1] * a + p[2] * greatest(0, least(1, z - 1)) + p[3] * greatest(0, least(1, (z - 2) / 2)) + p[4] * greatest(0, least(1, (z - 4) / 4)) + p[5] * b, 6) AS below,
  round(CASE WHEN z <= 1 THEN -ln(p[1]) - {0.5 * math.log(2 / math.pi) - math.log(_SIDE[0])!r} + pow(greatest(1 - z, 1e-8) / {_SIDE[0]!r}, 2) / 2
    WHEN z <= 2 THEN -ln(p[2]) WHEN z <= 4 THEN -ln(p[3] / 2) WHEN z <= 8 THEN -ln(p[4] / 4)
    ELSE -ln(p[5]) - {0.5 * math.log(2 / math.pi) - math.log(_SIDE[1])!r} + pow(greatest(z - 8, 1e-8) / {_SIDE[1]!r}, 2) / 2 END, 6) AS nll, 0.03 AS back
FROM parts
""",
    "bar_repaired": f"""
SELECT event_id, round(((ln(2) / 2) * p[2] + (ln(2) + ln(4)) / 2 * p[3] + (ln(4) + ln(8)) / 2 * p[4] + (ln(8) + ln(16)) / 2 * p[5]) / (1 - p[1]), 7) AS log_mean, 1.0 AS log_total,
  round(list_sum(list_transform(range(1, 6), lambda i: -p[i] * (lo[i] + CASE WHEN i = 5 THEN 16 - 1.6 ELSE hi[i] END) / 2)), 7) AS turned_mean FROM {_B}
""",
}
