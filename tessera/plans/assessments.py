"""Queries of reports, distances and metrics by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assessment as a
from tessera.sources.tables import table


def _runs(spark, sf_dir):
    """Mean discount by return flag (dataset), line number less one (rate) and supplier modulo five (run)."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_suppkey", "l_discount")
    return rows.groupBy("l_returnflag", (F.col("l_linenumber") - 1).cast("double").alias("rate"), (F.col("l_suppkey") % 5).alias("run")).agg(F.avg("l_discount").alias("v"))


_RUNS = "(SELECT l_returnflag, (l_linenumber - 1)::DOUBLE AS rate, l_suppkey % 5 AS run, avg(l_discount) AS v FROM lineitem GROUP BY ALL)"


def noise_sweep(spark, sf_dir):
    out = a.noise_sweep(_runs(spark, sf_dir), "l_returnflag", "rate", "v")
    return out.select("l_returnflag", "rate", "n", *(F.round(c, 8).alias(c) for c in ("mean", "std", "change")))


def repair_share(spark, sf_dir):
    """Statuses and brands of mean prices: the oracle O, the poisoned F, the method P, by priority."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(s) for s in "OFP"))
    share, unstable = a.repair_share(F.col("P"), F.col("F"), F.col("O"))
    return o.select("o_orderpriority", F.round(share, 6).alias("share"), unstable.alias("unstable"))


def no_skill(spark, sf_dir):
    return a.no_skill(table(spark, sf_dir, "embeddings"), "label").select("metric", F.round("value", 8).alias("value"))


def significance_order(spark, sf_dir):
    """Event types by mean value; the interval of a pair is the difference of means and 3 either way."""
    means = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("score"))
    p, q = means.alias("p"), means.alias("q")
    d = F.col("p.score") - F.col("q.score")
    pairs = p.join(q, F.col("p.method") < F.col("q.method")).select(F.col("p.method").alias("a"), F.col("q.method").alias("b"), (d - 3).alias("low"), (d + 3).alias("high"))  # a row a pair of types
    return a.significance_order(means, pairs).select("place", "method", F.round("score", 6).alias("score"), "relation")


def label_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y"), ((F.col("vec_id") % 4) != 0).alias("kept"), ((F.col("vec_id") % 6) == 1).alias("pois"))
    rows = rows.withColumn("given", F.when(F.col("pois"), (F.col("y") + 1) % 10).otherwise(F.col("y"))).withColumn("new", F.when(F.col("vec_id") % 5 == 2, F.col("y")).otherwise(F.col("given")))
    out = a.label_stats(rows, "kept", "given", "pois", "y", "new")
    return out.select(*(F.round(c, 8).alias(c) if k == "double" else c for c, k in out.dtypes))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    wide = lambda start: F.transform(F.slice("embedding", start, 4), lambda v: v.cast("double"))
    return e.select("vec_id", wide(1).alias("x"), wide(5).alias("o"))


def vector_distances(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(a.distance("x", "o", "Linf"), 6).alias("linf"), F.round(a.distance("x", "o", "L2"), 6).alias("l2"))


def ball_projection(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", a.projected("x", "o", 0.1, "Linf").alias("p"), a.projected("x", "o", 0.1, "L2").alias("q"))
    return v.select("vec_id", *(F.round(F.get(c, F.lit(i)), 6).alias(f"{c}{i}") for c in ("p", "q") for i in range(4)))


def clean_pairs(spark, sf_dir):
    """Each line beside its order's price, a pair of one to many."""
    clean = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    attacked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return a.paired(clean, attacked, "k", ["v"]).groupBy((F.col("attacked_v") > F.col("clean_v")).alias("above")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("orders"))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") < 10) & (F.col("l_discount") > 0.03)).alias("hit"))


def successful_candidates(spark, sf_dir):
    """Of each order the first two small discounted lines."""
    return a.succeeded(_candidates(spark, sf_dir), "l_orderkey", "hit", "l_linenumber", 2).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def unsuccessful_inputs(spark, sf_dir):
    return a.unsuccessful_inputs(_candidates(spark, sf_dir), "l_orderkey", "hit")


def metric_registry(spark, sf_dir):
    score = ((F.col("doc_id") * 7919) % 97 + 20 * F.col("toxic")) / 120.0
    rows = table(spark, sf_dir, "labels").select("toxic", F.array(1 - score, score).alias("probs"))
    return a.scored(rows, ["accuracy", "f1", "mcc", "brier", "ce", "roc_auc"], "probs", "toxic").select("metric", F.round("value", 6).alias("value"))


def pooled_bootstrap(spark, sf_dir):
    """Mean and spread of 50 resampled means of discounts, averaged over line numbers."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").alias("k"))
    return a.pooled_means(rows, "l_linenumber", "l_discount", 50, "k").agg(F.count("mean").alias("rounds"), F.round(F.min("mean"), 2).alias("low"), F.round(F.max("mean"), 2).alias("high"))


QUERIES = {f.__name__: f for f in (noise_sweep, repair_share, no_skill, significance_order, label_stats, vector_distances, ball_projection, clean_pairs, successful_candidates, unsuccessful_inputs, metric_registry, pooled_bootstrap)}

_V = "(SELECT vec_id, list_transform(embedding[1:4], lambda v: v::DOUBLE) AS x, list_transform(embedding[5:8], lambda v: v::DOUBLE) AS o FROM embeddings)"
_L2 = "sqrt(" + " + ".join(f"pow(x[{i}] - o[{i}], 2)" for i in range(1, 5)) + ")"
_HIT = "(SELECT l_orderkey, l_linenumber, l_quantity < 10 AND l_discount > 0.03 AS hit FROM lineitem)"
_S = "(SELECT toxic AS y, ((doc_id * 7919) % 97 + 20 * toxic) / 120.0 AS s FROM labels)"
ORACLES = {
    "pooled_bootstrap": """
WITH rows AS (
  SELECT l_linenumber, l_discount, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_shipdate AS k FROM lineitem
), weighted AS (
  SELECT round, l_linenumber, l_discount, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.999916758850712)::INT + (u >= 0.9999897508033253)::INT + (u >= 0.9999988747974019)::INT + (u >= 0.999999888574522)::INT + (u >= 0.9999999899522336)::INT + (u >= 0.9999999991683892)::INT AS w
  FROM (SELECT *, ('0x' || substr(md5('0|pooled|' || round || '|' || l_linenumber || '|' || k), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM rows, (SELECT unnest(range(50)) AS round))
)
SELECT count(m) AS rounds, round(min(m), 2) AS low, round(max(m), 2) AS high FROM (
  SELECT round, avg(m) AS m FROM (SELECT round, l_linenumber, sum(w * l_discount::DOUBLE) / nullif(sum(w), 0) AS m FROM weighted GROUP BY ALL) GROUP BY round)
""",
    "noise_sweep": f"SELECT l_returnflag, rate, n, round(mean, 8) AS mean, round(std, 8) AS std, round(mean - max(CASE WHEN rate = 0 THEN mean END) OVER (PARTITION BY l_returnflag), 8) AS change FROM (SELECT l_returnflag, rate, count(v) AS n, avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) END AS std FROM {_RUNS} GROUP BY 1, 2)",
    "repair_share": "SELECT o_orderpriority, round(CASE WHEN abs(o - f) >= 1e-12 THEN (p - f) / (o - f) END, 6) AS share, abs(o - f) < 1e-12 OR abs(o - f) < 0.02 * abs(f) AS unstable FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)",
    "no_skill": "WITH c AS (SELECT count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n) AS s, max(n) AS top, count(*) AS k, -sum(n / (SELECT sum(n) FROM c) * ln(n / (SELECT sum(n) FROM c))) AS ce FROM c) SELECT unnest(['accuracy', 'balanced_accuracy', 'mcc', 'roc_auc', 'ce']) AS metric, unnest([round(top / s, 8), round(1 / k, 8), 0, 0.5, round(ce, 8)]) AS value FROM t",
    "significance_order": "SELECT place, method, round(score, 6) AS score, CASE WHEN s2 IS NULL THEN NULL WHEN round(score, 9) = round(s2, 9) THEN '=' WHEN score - s2 > 3 THEN '>' ELSE '~' END AS relation FROM (SELECT row_number() OVER w AS place, method, score, lead(score) OVER w AS s2 FROM (SELECT event_type AS method, avg(value) AS score FROM events GROUP BY 1) WINDOW w AS (ORDER BY round(score, 9) DESC, method))",
    "label_stats": "WITH r AS (SELECT vec_id % 4 <> 0 AS kept, vec_id % 6 = 1 AS pois, label AS y, CASE WHEN vec_id % 6 = 1 THEN (label + 1) % 10 ELSE label END AS given, CASE WHEN vec_id % 6 = 1 AND vec_id % 5 <> 2 THEN (label + 1) % 10 ELSE label END AS new FROM embeddings) SELECT count(*) FILTER (kept) AS n_kept, round(avg(kept::INT), 8) AS share_kept, round(avg((new = y)::INT) FILTER (kept), 8) AS label_acc, round(1 - avg((new = y)::INT) FILTER (kept), 8) AS kept_wrong_share, round(avg(pois::INT) FILTER (kept), 8) AS kept_pois_share, count(*) FILTER (kept AND pois AND new = y) AS repaired, count(*) FILTER (kept AND new = y AND given <> new) AS relabelled, round(count(*) FILTER (NOT kept AND pois) / count(*) FILTER (NOT kept), 8) AS removal_precision, round(count(*) FILTER (NOT kept AND pois) / count(*) FILTER (pois), 8) AS removal_recall FROM r",
    "vector_distances": f"SELECT vec_id, round(greatest({', '.join(f'abs(x[{i}] - o[{i}])' for i in range(1, 5))}), 6) AS linf, round({_L2}, 6) AS l2 FROM {_V}",
    "ball_projection": "SELECT vec_id, " + ", ".join([f"round(least(greatest(x[{i + 1}], o[{i + 1}] - 0.1), o[{i + 1}] + 0.1), 6) AS p{i}" for i in range(4)] + [f"round(o[{i + 1}] + (x[{i + 1}] - o[{i + 1}]) * least(0.1, {_L2}) / ({_L2} + 1e-12), 6) AS q{i}" for i in range(4)]) + f" FROM {_V}",
    "clean_pairs": "SELECT l_extendedprice > o_totalprice AS above, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "successful_candidates": f"SELECT l_orderkey, least(2, count(*)) AS n FROM {_HIT} WHERE hit GROUP BY 1",
    "unsuccessful_inputs": f"SELECT l_orderkey FROM {_HIT} GROUP BY 1 HAVING NOT bool_or(hit)",
    "metric_registry": f"WITH r AS (SELECT y, s, (s > 1 - s)::INT AS g FROM {_S}), c AS (SELECT count(*) FILTER (g = 1 AND y = 1)::DOUBLE AS tp, count(*) FILTER (g = 1 AND y = 0)::DOUBLE AS fp, count(*) FILTER (g = 0 AND y = 1)::DOUBLE AS fn, count(*) FILTER (g = 0 AND y = 0)::DOUBLE AS tn FROM r) "
    "SELECT 'accuracy' AS metric, round((tp + tn) / (tp + tn + fp + fn), 6) AS value FROM c UNION ALL SELECT 'f1', round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) FROM c UNION ALL SELECT 'mcc', round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) FROM c "
    "UNION ALL SELECT 'brier', round(avg(pow(s - y, 2)), 6) FROM r UNION ALL SELECT 'ce', round(-avg(ln(greatest(CASE WHEN y = 1 THEN s ELSE 1 - s END, 1e-12))), 6) FROM r UNION ALL SELECT 'roc_auc', round((SELECT avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) FROM r p, r n WHERE p.y = 1 AND n.y = 0), 6)",
}
