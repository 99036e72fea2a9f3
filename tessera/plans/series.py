"""Queries of the time series operators on events: user_id is the item, value the target, null where event_id is divisible by 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.series import Series, chained
from tessera.sources.tables import table


def _series(spark: SparkSession, sf_dir: str) -> Series:
    """Each user's last event of a moment, so that (item, timestamp) is a key."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.col("user_id").alias("item_id"), F.col("ts").alias("timestamp")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return Series(rows.select("item_id", "timestamp", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("target")))


_S = "(SELECT user_id AS item_id, ts AS timestamp, max(event_id) AS event_id, CASE WHEN max(event_id) % 7 <> 0 THEN arg_max(value, event_id) END AS target FROM events GROUP BY 1, 2)"
_P = f"(SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp) - 1 AS place, count(*) OVER (PARTITION BY item_id) AS n FROM {_S})"
_T = "round(target, 6) AS target"


def _shown(s: Series, *more: str) -> DataFrame:
    return s.df.select("item_id", "event_id", F.round("target", 6).alias("target"), *more)


def ts_slice_tail(spark, sf_dir):
    return _shown(_series(spark, sf_dir).slice(-3, None))


def ts_slice_negative(spark, sf_dir):
    return _shown(_series(spark, sf_dir).slice(2, -4))


def ts_slice_by_time(spark, sf_dir):
    return _shown(_series(spark, sf_dir).between("2024-01-05", "2024-01-20"))


def ts_split_by_time(spark, sf_dir):
    a, b = _series(spark, sf_dir).split_at("2024-01-15")
    return a.df.select(F.lit("before").alias("part")).unionByName(b.df.select(F.lit("after").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


def ts_train_test_split(spark, sf_dir):
    a, b = _series(spark, sf_dir).train_test(5, "_x")
    return a.df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_train")).join(b.df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_test")), "item_id", "right").select("item_id", F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test")


def ts_running_index(spark, sf_dir):
    s = Series(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return s.df.select("conv_id", "turn", s.running_index().alias("place"))


def _fill(method, value=None):
    def query(spark, sf_dir):
        return _shown(_series(spark, sf_dir).filled(method, value))

    return query


def ts_target_impute(spark, sf_dir):
    return _shown(_series(spark, sf_dir).imputed_target())


def ts_frequency(spark, sf_dir):
    daily = _series(spark, sf_dir).resampled("day", "sum")
    return daily.steps().select("item_id", "n", "least", "most")


def _resample(unit, how):
    def query(spark, sf_dir):
        return _series(spark, sf_dir).resampled(unit, how).df.select("item_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("bin"), F.round("target", 6).alias("target"))

    return query


def ts_horizon(spark, sf_dir):
    return _series(spark, sf_dir).resampled("day", "mean").horizon(4, "1 day").select("item_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "target")


def ts_calendar(spark, sf_dir):
    df = _series(spark, sf_dir).calendar().df
    return df.select("event_id", "year", *(F.round(f"{f}_{g}", 6).alias(f"{f}_{g}") for f in ("minute", "hour", "weekday", "day", "dayofyear", "week", "month") for g in ("sin", "cos")))


def ts_fourier(spark, sf_dir):
    return _series(spark, sf_dir).fourier([7, 24.5]).df.select("event_id", *(F.round(c, 6).alias(c) for c in ("sin_0", "cos_0", "sin_1", "cos_1")))


def ts_first_diff(spark, sf_dir):
    s = _series(spark, sf_dir).filled("auto")
    return s.df.select("event_id", F.round(s.first_difference(), 6).alias("d"))


def ts_linear_detrend(spark, sf_dir):
    return _shown(_series(spark, sf_dir).filled("auto").detrended())


def ts_constant_detrend(spark, sf_dir):
    return _shown(_series(spark, sf_dir).detrended("constant"))


def ts_static_join(spark, sf_dir):
    s = _series(spark, sf_dir)
    static = s.df.groupBy("item_id").agg(F.min("event_id").alias("first_event"))
    return s.with_static(static).groupBy("item_id").agg(F.count_if(F.col("event_id") == F.col("first_event")).alias("n"))


def ts_transform_chain(spark, sf_dir):
    s = _series(spark, sf_dir).resampled("day", "mean")
    context, future = chained(s, s.horizon(3, "1 day"), [lambda x: x.calendar(["weekday"]), lambda x: x.fourier([7])])
    return future.select("item_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.round("weekday_sin", 6).alias("weekday_sin"), F.round("sin_0", 6).alias("sin_0"))


def ts_last_timestamp(spark, sf_dir):
    return _series(spark, sf_dir).df.groupBy("item_id").agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last"))


_FORMS = {"mean": "avg(target)", "sum": "coalesce(sum(target), 0)", "min": "min(target)", "max": "max(target)", "median": "quantile_cont(target, 0.5)", "first": "arg_min(target, timestamp) FILTER (target IS NOT NULL)", "last": "arg_max(target, timestamp) FILTER (target IS NOT NULL)"}


def _bins(unit, how):
    empty = "coalesce(b.target, 0)" if how == "sum" else "b.target"
    return f"""(WITH b AS (SELECT item_id, date_trunc('{unit}', timestamp) AS bin, {_FORMS[how]} AS target FROM {_S} GROUP BY 1, 2),
g AS (SELECT item_id, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 1 {unit})) AS bin FROM b GROUP BY 1)
SELECT g.item_id, g.bin, {empty} AS target FROM g LEFT JOIN b ON g.item_id = b.item_id AND g.bin = b.bin)"""


def _prev(what="target"):
    return f"last_value({what} IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _next(what="target"):
    return f"first_value({what} IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


_AUTO = f"(SELECT item_id, timestamp, event_id, coalesce({_prev()}, {_next()}) AS target FROM {_S})"
_PARTS = {"minute": ("minute(timestamp)", 60), "hour": ("hour(timestamp)", 24), "weekday": ("(isodow(timestamp) - 1)", 7), "day": ("(day(timestamp) - 1)", 30.5), "dayofyear": ("(dayofyear(timestamp) - 1)", 366), "week": ("(week(timestamp) - 1)", 53), "month": ("(month(timestamp) - 1)", 12)}
QUERIES = {f.__name__: f for f in (ts_slice_tail, ts_slice_negative, ts_slice_by_time, ts_split_by_time, ts_train_test_split, ts_running_index, ts_target_impute, ts_frequency, ts_horizon, ts_calendar, ts_fourier, ts_first_diff, ts_linear_detrend, ts_constant_detrend, ts_static_join, ts_transform_chain, ts_last_timestamp)}
QUERIES |= {f"ts_{n}": _fill(m, v) for n, m, v in (("ffill", "ffill", None), ("bfill", "bfill", None), ("auto_fill", "auto", None), ("interpolate", "interpolate", None), ("constant_fill", "constant", -1.0))}
QUERIES |= {f"ts_resample_{how}": _resample("day", how) for how in _FORMS} | {"ts_resample_month": _resample("month", "mean"), "ts_resample_hour_sum": _resample("hour", "sum")}
ORACLES = {
    "ts_slice_tail": f"SELECT item_id, event_id, {_T} FROM {_P} WHERE place >= n - 3",
    "ts_slice_negative": f"SELECT item_id, event_id, {_T} FROM {_P} WHERE place >= 2 AND place < greatest(n - 4, 0)",
    "ts_slice_by_time": f"SELECT item_id, event_id, {_T} FROM {_S} WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20'",
    "ts_split_by_time": f"SELECT CASE WHEN timestamp < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS part, count(*) AS n_rows FROM {_S} GROUP BY 1",
    "ts_train_test_split": f"SELECT item_id || '_x' AS item_id, count(*) FILTER (place < n - 5) AS n_train, count(*) AS n_test FROM {_P} GROUP BY 1",
    "ts_running_index": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place FROM conversations",
    "ts_target_impute": f"SELECT item_id, event_id, round(CASE WHEN k <= 1 THEN coalesce(target, 0) ELSE target END, 6) AS target FROM (SELECT *, count(target) OVER (PARTITION BY item_id) AS k FROM {_S}) WHERE k <= 1 OR target IS NOT NULL",
    "ts_frequency": f"SELECT item_id, count(*) AS n, min(g) AS least, max(g) AS most FROM (SELECT item_id, epoch(bin)::BIGINT - epoch(lag(bin) OVER (PARTITION BY item_id ORDER BY bin))::BIGINT AS g FROM {_bins('day', 'sum')}) GROUP BY 1",
    "ts_horizon": f"SELECT item_id, strftime(m + to_days(k::INT), '%Y-%m-%d') AS day, NULL::DOUBLE AS target FROM (SELECT item_id, max(bin)::TIMESTAMP AS m, unnest(range(1, 5)) AS k FROM {_bins('day', 'mean')} GROUP BY 1)",
    "ts_calendar": f"SELECT event_id, year(timestamp)::INT AS year, {', '.join(f'round(sin(2 * pi() * {e} / {p}), 6) AS {n}_sin, round(cos(2 * pi() * {e} / {p}), 6) AS {n}_cos' for n, (e, p) in _PARTS.items())} FROM {_S}",
    "ts_fourier": f"SELECT event_id, round(sin(2 * pi() * place / 7), 6) AS sin_0, round(cos(2 * pi() * place / 7), 6) AS cos_0, round(sin(2 * pi() * place / 24.5), 6) AS sin_1, round(cos(2 * pi() * place / 24.5), 6) AS cos_1 FROM {_P}",
    "ts_first_diff": f"SELECT event_id, round(target - lag(target, 1, target) OVER (PARTITION BY item_id ORDER BY timestamp), 6) AS d FROM {_AUTO}",
    "ts_linear_detrend": f"SELECT item_id, event_id, round(target - (coalesce(regr_slope(target, p) OVER w, 0) * (p - avg(p) OVER w) + avg(target) OVER w), 6) AS target FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY timestamp) - 1)::DOUBLE AS p FROM {_AUTO}) WINDOW w AS (PARTITION BY item_id)",
    "ts_constant_detrend": f"SELECT item_id, event_id, round(target - avg(target) OVER (PARTITION BY item_id), 6) AS target FROM {_S}",
    "ts_static_join": f"SELECT item_id, 1::BIGINT AS n FROM {_S} GROUP BY 1",
    "ts_transform_chain": f"SELECT item_id, strftime(m + to_days(k::INT), '%Y-%m-%d') AS day, round(sin(2 * pi() * (isodow(m + to_days(k::INT)) - 1) / 7), 6) AS weekday_sin, round(sin(2 * pi() * (n - 1 + k) / 7), 6) AS sin_0 FROM (SELECT item_id, max(bin)::TIMESTAMP AS m, count(*) AS n, unnest(range(1, 4)) AS k FROM {_bins('day', 'mean')} GROUP BY 1)",
    "ts_last_timestamp": f"SELECT item_id, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last FROM {_S} GROUP BY 1",
    "ts_ffill": f"SELECT item_id, event_id, round({_prev()}, 6) AS target FROM {_S}",
    "ts_bfill": f"SELECT item_id, event_id, round({_next()}, 6) AS target FROM {_S}",
    "ts_auto_fill": f"SELECT item_id, event_id, {_T} FROM {_AUTO}",
    "ts_interpolate": f"SELECT item_id, event_id, round(CASE WHEN target IS NOT NULL THEN target WHEN b IS NULL THEN x WHEN a IS NOT NULL THEN x + (y - x) * (place - a) / (b - a) END, 6) AS target FROM (SELECT *, {_prev()} AS x, {_next()} AS y, {_prev('CASE WHEN target IS NOT NULL THEN place END')} AS a, {_next('CASE WHEN target IS NOT NULL THEN place END')} AS b FROM {_P})",
    "ts_constant_fill": f"SELECT item_id, event_id, round(coalesce(target, -1), 6) AS target FROM {_S}",
} | {f"ts_resample_{how}": f"SELECT item_id, strftime(bin, '%Y-%m-%d %H:%M') AS bin, {_T} FROM {_bins('day', how)}" for how in _FORMS} | {"ts_resample_month": f"SELECT item_id, strftime(bin, '%Y-%m-%d %H:%M') AS bin, {_T} FROM {_bins('month', 'mean')}", "ts_resample_hour_sum": f"SELECT item_id, strftime(bin, '%Y-%m-%d %H:%M') AS bin, {_T} FROM {_bins('hour', 'sum')}"}
