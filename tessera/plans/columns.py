"""Queries of column pipelines and synthetic columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keys import uniform
from tessera.operators import schema as sc
from tessera.operators import synthetic as sy
from tessera.sources import batches as bt
from tessera.sources.tables import table


def _e(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")


def inf_round_trip(spark, sf_dir):
    """Infinities stay where a clip at 50 would have taken them, and in the column made from theirs."""
    df = _e(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).when(F.col("event_id") % 9 == 1, F.lit(-float("inf"))).otherwise(F.col("value")))
    out = sc.around_infinities(df, ["value"], lambda d: d.withColumn("half", F.col("value") / 2).withColumn("value", F.least(F.col("value"), F.lit(50.0))), {"half": "value"})
    return out.agg(F.count_if(F.col("value") == float("inf")).alias("high"), F.count_if(F.col("half") == -float("inf")).alias("low"), F.round(F.sum(F.when(F.abs("value") < float("inf"), F.col("value"))), 4).alias("rest"))


def dtype_alignment(spark, sf_dir):
    df = _e(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 == 0, "odd").otherwise(F.col("user_id").cast("string")).alias("user_id"))
    out = sc.aligned(df, [("event_id", "bigint"), ("user_id", "int"), ("gone", "double")])
    return out.agg(F.count("user_id").alias("parsed"), F.count("gone").alias("gone"), F.count(F.lit(1)).alias("n"))


def masked_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("v"))
    out = sc.select_features(F.col("v"), F.transform(F.col("v"), lambda x: x > 0), 4)
    return e.select("vec_id", *(F.round(F.get(out, F.lit(i)), 6).alias(f"x{i}") for i in range(4)))


def bucketised(spark, sf_dir):
    return _e(spark, sf_dir).select("event_id", sc.bucket(F.col("value"), [5.0, 20.0, 50.0, 90.0]).alias("bucket"))


def weighted_moments(spark, sf_dir):
    df = _e(spark, sf_dir).withColumn("w", F.col("event_id") % 4)
    return sc.weighted_moments(df, "value", "w", ["user_id"]).select("user_id", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


def synthetic_columns(spark, sf_dir):
    """Synthetic values for every event, keyed by its number."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    x, y = sy.circle(1, "circle")
    return df.select("row_id", F.round(sy.normal(1, "n"), 6).alias("normal"), sy.choice(1, "c", [5, 3, 2]).alias("choice"), sy.zipf(1, "z").alias("zipf"), F.round(sy.log_uniform(1, "l", 0.1, 10.0), 6).alias("log_uniform"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def regression_to_classes(spark, sf_dir):
    return sy.classes_by_rank(_e(spark, sf_dir), "value", 4).select("event_id", sy.permuted_classes("class", [2, 0, 3, 1]).alias("class"))


def temperature_draws(spark, sf_dir):
    e = _e(spark, sf_dir).select("event_id", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("p"))
    return e.select("event_id", sy.by_temperature(F.col("p"), 0.5, uniform(3, "t", "event_id")).alias("class"))


def activations(spark, sf_dir):
    e = _e(spark, sf_dir).select("event_id", ((F.col("value") - 50) / 20).alias("v"))
    return e.select("event_id", *(F.round(f(F.col("v")), 6).alias(n) for n, f in sy.ACTIVATIONS.items()))


def ensemble_features(spark, sf_dir):
    """How often each entry of the embeddings serves over subsets of 24, and its sum over all rows, once for each time it serves."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    width = e.agg(F.max(F.size("v"))).first()[0] or 0
    subsets = sc.feature_subsets([f"c{i}" for i in range(width)], 5, 24)
    served = spark.createDataFrame([(c,) for s in subsets for c in s], "name string")
    sums = e.select(F.posexplode("v").alias("i", "x")).groupBy(F.concat(F.lit("c"), F.col("i")).alias("name")).agg(F.sum("x").alias("x"))
    return served.join(sums, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 5).alias("served"))


QUERIES = {f.__name__: f for f in (inf_round_trip, dtype_alignment, masked_features, bucketised, weighted_moments, synthetic_columns, regression_to_classes, temperature_draws, activations, ensemble_features)}


def _u(seed, stream, column="row_id"):
    return f"(('0x' || substr(md5('{seed}|{stream}|' || {column}), 1, 8))::BIGINT / 4294967296.0)"


_Z = [k**-2.0 for k in range(1, 11)]
_ZC = [sum(_Z[:k]) / sum(_Z) for k in range(1, 10)]
_V = "((value - 50) / 20)"
ORACLES = {
    "inf_round_trip": "SELECT count(*) FILTER (event_id % 9 = 0) AS high, count(*) FILTER (event_id % 9 = 1) AS low, round(sum(CASE WHEN event_id % 9 > 1 THEN least(value, 50) END), 4) AS rest FROM events",
    "dtype_alignment": "SELECT count(*) FILTER (event_id % 5 <> 0) AS parsed, 0::BIGINT AS gone, count(*) AS n FROM events",
    "masked_features": "SELECT vec_id, " + ", ".join(f"round(coalesce(f[{i + 1}], 0), 6) AS x{i}" for i in range(4)) + " FROM (SELECT vec_id, list_filter(list_transform(embedding[1:4], lambda v: v::DOUBLE), lambda v: v > 0) AS f FROM embeddings)",
    "bucketised": "SELECT event_id, ((value > 5)::INT + (value > 20)::INT + (value > 50)::INT + (value > 90)::INT)::INT AS bucket FROM events",
    "weighted_moments": "SELECT user_id, round(wx / w, 6) AS mean, round(CASE WHEN w > 1 THEN sqrt(greatest(0, (wxx - w * (wx / w) * (wx / w)) / (w - 1))) END, 5) AS std FROM (SELECT user_id, sum(event_id % 4) AS w, sum((event_id % 4) * value) AS wx, sum((event_id % 4) * value * value) AS wxx FROM events GROUP BY 1)",
    "synthetic_columns": f"SELECT row_id, round(sqrt(-2 * ln(greatest({_u(1, 'n/a')}, pow(2.0, -33)))) * cos(2 * pi() * {_u(1, 'n/b')}), 6) AS normal, CASE WHEN {_u(1, 'c')} < 0.5 THEN 0 WHEN {_u(1, 'c')} < 0.8 THEN 1 ELSE 2 END AS choice, 1 + len(list_filter({_ZC}, lambda b: b <= {_u(1, 'z')}))::INT AS zipf, round(0.1 * pow(100.0, {_u(1, 'l')}), 6) AS log_uniform, round(cos(2 * pi() * {_u(1, 'circle')}), 6) AS x, round(sin(2 * pi() * {_u(1, 'circle')}), 6) AS y FROM (SELECT event_id AS row_id FROM events)",
    "regression_to_classes": "SELECT event_id, [2, 0, 3, 1][len(list_filter(q, lambda b: b < value)) + 1]::INT AS class FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)",
    "temperature_draws": f"SELECT event_id, CASE WHEN {_u(3, 't', 'event_id')} < 0.25 / 0.38 THEN 0 WHEN {_u(3, 't', 'event_id')} < 0.34 / 0.38 THEN 1 ELSE 2 END AS class FROM events",
    "activations": f"SELECT event_id, round(sign({_V}), 6) AS sign, ({_V} >= 0)::INT::DOUBLE AS step, round(exp(-{_V} * {_V}), 6) AS bell, round(greatest({_V}, 0), 6) AS relu, round(ln(1 + exp(-abs({_V}))) + greatest({_V}, 0), 6) AS softplus, round((exp(2 * {_V}) - 1) / (exp(2 * {_V}) + 1), 6) AS tanh, round({_V} * {_V}, 6) AS square, round(sqrt(abs({_V})), 6) AS root, round(sin({_V}), 6) AS wave, round({_V} - floor({_V}), 6) AS fraction, round({_V}, 6) AS nothing FROM events",
    "ensemble_features": "SELECT 'c' || (i - 1) AS name, any_value(n) AS n, round(any_value(n) * sum(x), 5) AS served FROM (SELECT i, embedding[i]::DOUBLE AS x, count(*) AS n FROM embeddings, (SELECT unnest(range(1, 65)) AS i) JOIN (SELECT k % 64 + 1 AS slot FROM (SELECT unnest(range(120)) AS k)) ON slot = i GROUP BY vec_id, i, x) GROUP BY i",
}


def prior_batches(spark, sf_dir):
    """Batches of 64 embeddings with small entries cleared, packed and unpacked, and dealt to three ranks, the last rounds dropped."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 64).cast("int").alias("batch"), F.transform("embedding", lambda v: F.when(F.abs(v) > 0.1, v.cast("double")).otherwise(0.0)).alias("x"))
    n = e.select("batch").distinct().count()
    back = e.withColumn("y", bt.dense(bt.sparse(F.col("x"))))
    same = (F.col("y") == F.col("x")).cast("int")
    parts = [bt.assigned(back, "batch", r, 3, n).withColumn("rank", F.lit(r)) for r in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = every.groupBy("rank", "batch").agg(F.min(same).alias("same"), F.round(F.sum(F.aggregate("y", F.lit(0.0), lambda s, v: s + v)), 5).alias("total"))
    return sums.join(bt.metadata(e, "batch", "x", "label"), "batch")


QUERIES["prior_batches"] = prior_batches
ORACLES["prior_batches"] = """
WITH e AS (
  SELECT vec_id // 64 AS batch, label, list_transform(embedding, lambda v: CASE WHEN abs(v) > 0.1 THEN v::DOUBLE ELSE 0.0 END) AS x FROM embeddings
)
SELECT (batch % 3)::INT AS rank, batch::INT AS batch, 1 AS same, round(sum(list_sum(x)), 5) AS total, count(*) AS n_rows, 64 AS width, sum(len(list_filter(x, lambda v: v <> 0)))::BIGINT AS entries, count(DISTINCT label) AS labels
FROM e WHERE batch < (SELECT count(DISTINCT batch) // 3 * 3 FROM e) GROUP BY batch
"""
