"""Queries of bagged trees over all embeddings, whose given label is turned where vec_id is divisible by 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bagging as bg
from tessera.sources.tables import table

WIDTH, CLASSES, TREES, SOME = 64, list(range(10)), 10, 8


def _votes(spark, sf_dir, depth, bins=16):
    given = F.when(F.col("vec_id") % 6 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("given", given)
    return bg.out_of_bag(rows, "embedding", bg.one_hot("given", CLASSES), len(CLASSES), width=WIDTH, id_column="vec_id", trees=TREES, depth=depth, bins=bins, some=SOME)


def bagged_stumps(spark, sf_dir):
    """Trees of one split: how many lack a row in their bag, and how many of these say its label."""
    return _votes(spark, sf_dir, 1, 8).select("vec_id", F.col("trees").cast("long").alias("trees"), F.coalesce("hits", F.lit(0)).alias("hits"))


def bagged_label_scores(spark, sf_dir):
    """Suspicion of every label by out-of-bag trees."""
    return bg.label_scores(_votes(spark, sf_dir, 5), "vec_id")


def learnable_table(spark, sf_dir):
    """Whether the table has a signal that isn't trivial."""
    return bg.learnable(_votes(spark, sf_dir, 5), len(CLASSES), "vec_id")


QUERIES = {f.__name__: f for f in (bagged_stumps, bagged_label_scores, learnable_table)}

_U = "('0x' || substr(md5('0|bag|' || t || '|' || id), 1, 8))::BIGINT / 4294967296.0"
#: Cumulated Poisson probabilities of mean 1.
_STEPS = "(SELECT list(s ORDER BY k) FROM (SELECT k, sum(exp(-1.0::DOUBLE) / factorial(k)) OVER (ORDER BY k) AS s FROM (SELECT unnest(range(0, 12))::INT AS k)))"
ORACLES = {
    "bagged_stumps": f"""
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN (label + 1) % 10 ELSE label END AS y, embedding FROM embeddings
), x AS (
  SELECT id, y, f, embedding[f + 1]::DOUBLE AS v FROM e, (SELECT unnest(range(0, {WIDTH})) AS f)
), b AS (
  SELECT DISTINCT f, q FROM (SELECT f, unnest(quantile_disc(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS q FROM x GROUP BY f)
), codes AS (
  SELECT x.id, x.f, count(b.q) AS code FROM x LEFT JOIN b ON b.f = x.f AND b.q < x.v GROUP BY 1, 2
), w AS (
  SELECT id, y, t, len(list_filter({_STEPS}, lambda s: s <= {_U})) AS w FROM e, (SELECT unnest(range(0, {TREES})) AS t)
), asked AS (
  SELECT t, f FROM (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY md5('0|feature|' || t || '|1|' || f)) AS r FROM (SELECT unnest(range(0, {TREES})) AS t), (SELECT unnest(range(0, {WIDTH})) AS f)) WHERE r <= {SOME}
), cells AS (
  SELECT t, f, code, y, sum(w) AS n FROM w JOIN asked USING (t) JOIN codes USING (id, f) WHERE w > 0 GROUP BY ALL
), sides AS (
  SELECT t, f, cut, code <= cut AS l, y, sum(n) AS n FROM (SELECT DISTINCT t, f, code AS cut FROM cells) JOIN cells USING (t, f) GROUP BY ALL
), halves AS (
  SELECT t, f, cut, l, sum(n * n) / sum(n) AS q FROM sides GROUP BY ALL
), whole AS (
  SELECT t, sum(n * n) / sum(n) AS q FROM (SELECT t, y, sum(w) AS n FROM w GROUP BY ALL) GROUP BY t
), gains AS (
  SELECT t, f, cut, round(sum(halves.q) - any_value(whole.q), 9) AS gain FROM halves JOIN whole USING (t) GROUP BY t, f, cut HAVING count(*) = 2
), best AS (
  SELECT t, f, cut FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gain DESC, f, cut) AS r FROM gains WHERE gain > 0) WHERE r = 1
), placed AS (
  SELECT id, y, t, w, code <= cut AS l FROM w JOIN best USING (t) JOIN codes USING (id, f)
), said AS (
  SELECT t, l, y AS s FROM (SELECT t, l, y, row_number() OVER (PARTITION BY t, l ORDER BY sum(w) DESC, y) AS r FROM placed WHERE w > 0 GROUP BY t, l, y) WHERE r = 1
), votes AS (
  SELECT id, count(*) AS trees, sum((y = s)::INT) AS hits FROM placed JOIN said USING (t, l) WHERE w = 0 GROUP BY id
)
SELECT e.id AS vec_id, coalesce(trees, 0)::BIGINT AS trees, coalesce(hits, 0)::BIGINT AS hits FROM e LEFT JOIN votes USING (id)
""",
}
