"""Queries of models a series: events of users before and from 24 January."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import forecast as fc
from tessera.operators.loops import cut
from tessera.plans.series import _series

LEVELS, SEASON, CUT = [0.1, 0.5, 0.9], 7, "2024-01-24"


def _sides(spark, sf_dir):
    """Context with hour and source, future with hour and weekday; only hour is shared."""
    s = _series(spark, sf_dir)
    a, b = s.split_at(CUT)
    past = a.with_df(a.df.select("item_id", "timestamp", "target", F.hour("timestamp").alias("hour"), F.lit("log").alias("source")))
    return past, b.df.select("item_id", "timestamp", F.hour("timestamp").alias("hour"), F.dayofweek("timestamp").alias("weekday"))


def _shown(rows):
    return rows.select("item_id", "timestamp", F.round("target", 6).alias("target"), *(F.round(F.get("quantiles", F.lit(i)), 6).alias(f"q{i}") for i in range(3)))


def series_model(spark, sf_dir):
    past, ahead = _sides(spark, sf_dir)
    return _shown(fc.forecast(past, ahead, fc.seasonal_naive(SEASON), LEVELS, part=16))


def series_ensemble(spark, sf_dir):
    """Two members, one of which saw the targets centred and scaled a user."""
    past, ahead = _sides(spark, sf_dir)
    past, ahead = past.with_df(cut(past.df)), cut(ahead)  # several steps read them
    plain = fc.forecast(past, ahead, fc.seasonal_naive(SEASON), LEVELS)
    scales = past.imputed_target().df.groupBy("item_id").agg(F.avg("target").alias("mean"), F.greatest(F.stddev_pop("target"), F.lit(1e-6)).alias("scale"))
    scaled = past.with_df(past.imputed_target().df.join(scales, "item_id").withColumn("target", (F.col("target") - F.col("mean")) / F.col("scale")).drop("mean", "scale"))
    other = fc.forecast(scaled, ahead, fc.seasonal_naive(1), LEVELS)
    both = scales.withColumn("member", F.lit(1)).unionByName(scales.select("item_id", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"), F.lit(0).alias("member")))
    return _shown(fc.averaged([plain, other], "item_id", "timestamp", both))


def aligned_covariates(spark, sf_dir):
    """The columns that context and future share, by item: rows on either side and the sums of what is shared."""
    past, ahead = _sides(spark, sf_dir)
    a, b, shared = fc.covariates(past.df, ahead, ["item_id", "timestamp", "target"])
    assert shared == ["hour"] and "weekday" not in b.columns and "source" not in a.columns
    both = a.select("item_id", F.lit("context").alias("side"), "hour").unionByName(b.select("item_id", F.lit("future").alias("side"), "hour"))
    return both.groupBy("item_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("hour").cast("long").alias("hours"))


QUERIES = {f.__name__: f for f in (series_model, series_ensemble, aligned_covariates)}

_EVENTS = "(SELECT user_id AS item_id, ts AS timestamp, CASE WHEN max(event_id) % 7 <> 0 THEN arg_max(value, event_id) END AS target FROM events GROUP BY 1, 2)"


def _model(season, y="target"):
    return f"""
  SELECT f.item_id, f.timestamp, f.step, c.y, coalesce(c.y[CASE WHEN len(c.y) >= {season} THEN len(c.y) - {season} + (f.step - 1) % {season} + 1 ELSE len(c.y) END], NULL) AS point,
    CASE WHEN len(c.y) > {season} THEN list_transform(range({season} + 1, len(c.y) + 1), lambda i: c.y[i] - c.y[i - {season}]) ELSE CASE WHEN c.y IS NOT NULL THEN [0.0] END END AS changes
  FROM ahead f LEFT JOIN context c ON c.item_id = f.item_id
"""


_CONTEXT = f"""
WITH ahead AS (
  SELECT item_id, timestamp, row_number() OVER (PARTITION BY item_id ORDER BY timestamp) AS step FROM {_EVENTS} WHERE timestamp >= '{CUT}'
), past AS (
  SELECT item_id, timestamp, CASE WHEN count(target) OVER (PARTITION BY item_id) <= 1 THEN coalesce(target, 0) ELSE target END AS target FROM {_EVENTS} WHERE timestamp < '{CUT}'
), context AS (
  SELECT item_id, list(target ORDER BY timestamp) AS y, avg(target) AS mean, greatest(stddev_pop(target), 1e-6) AS scale FROM past WHERE target IS NOT NULL GROUP BY 1
), model AS ({_model(SEASON)})"""
_Q = "list_aggregate(changes, 'quantile_cont', {})"
ORACLES = {
    "series_model": _CONTEXT + " SELECT item_id, timestamp, round(point, 6) AS target, " + ", ".join(f"round(point + {_Q.format(a)}, 6) AS q{i}" for i, a in enumerate(LEVELS)) + " FROM model",
    "series_ensemble": _CONTEXT
    + f", last AS ({_model(1)}), joined AS (SELECT m.item_id, m.timestamp, m.point AS p, l.point AS r, m.changes AS a, l.changes AS b FROM model m JOIN last l ON m.item_id = l.item_id AND m.timestamp = l.timestamp WHERE m.y IS NOT NULL)"
    + " SELECT item_id, timestamp, round((p + r) / 2, 6) AS target, "
    + ", ".join(f"round((p + list_aggregate(a, 'quantile_cont', {x}) + r + list_aggregate(b, 'quantile_cont', {x})) / 2, 6) AS q{i}" for i, x in enumerate(LEVELS))
    + " FROM joined",
    "aligned_covariates": f"SELECT item_id, CASE WHEN timestamp < '{CUT}' THEN 'context' ELSE 'future' END AS side, count(*) AS n, sum(hour(timestamp))::BIGINT AS hours FROM {_EVENTS} GROUP BY 1, 2",
}
