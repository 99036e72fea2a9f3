"""Queries of samples, splits and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.sources.tables import table


def _e(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


def _key(seed, stream, column="vec_id"):
    return f"md5('{seed}|{stream}|' || {column})"


def _uniform(seed, stream, column="vec_id"):
    return f"('0x' || substr({_key(seed, stream, column)}, 1, 8))::BIGINT / 4294967296.0"


def sample_k(spark, sf_dir):
    return sampling.sample_k(_e(spark, sf_dir), 40, "vec_id")


def sample_bernoulli(spark, sf_dir):
    return sampling.bernoulli(_e(spark, sf_dir), 0.2, "vec_id")


def split_stratified_round(spark, sf_dir):
    return sampling.stratified(_e(spark, sf_dir), "label", 0.25, "vec_id")


def split_largest_remainder(spark, sf_dir):
    return sampling.exact_split(_e(spark, sf_dir), "label", 77, "vec_id")


def draw_per_class(spark, sf_dir):
    return sampling.per_class(_e(spark, sf_dir), "label", 5, "vec_id")


def nested_children(spark, sf_dir):
    return sampling.sample_k(sampling.sample_k(_e(spark, sf_dir), 100, "vec_id"), 30, "vec_id")


def kfold(spark, sf_dir):
    return sampling.folds(_e(spark, sf_dir), "label", 4, "vec_id")


def chunk_shard(spark, sf_dir):
    return sampling.chunks(_e(spark, sf_dir), "label", 16, 8, "vec_id").groupBy("label", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))


def balanced_rows(spark, sf_dir):
    return sampling.balanced_rows(_e(spark, sf_dir), 7, 400, "vec_id")


def split_by_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "train").when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "validation").otherwise("test")
    return o.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def capped_quota_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    quota = sampling.capped_quotas(sampling.class_counts(o, "o_orderstatus"), 300)
    return sampling.take_quota(o, "o_orderstatus", quota, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (sample_k, sample_bernoulli, split_stratified_round, split_largest_remainder, draw_per_class, nested_children, kfold, chunk_shard, balanced_rows, split_by_date, capped_quota_draw)}
_R = f"(SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_key(0, 'split')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"
ORACLES = {
    # equal shares, then one row after the other to the class with most room, the first of equals
    "capped_quota_draw": """
WITH RECURSIVE counts AS (
  SELECT list(o_orderstatus ORDER BY o_orderstatus) AS names, list(n ORDER BY o_orderstatus) AS ns FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
), rounds(names, ns, quota, lacking) AS (
  SELECT names, ns, list_transform(ns, lambda v: least(300 // len(ns), v)), least(300, list_sum(ns)) - list_sum(list_transform(ns, lambda v: least(300 // len(ns), v))) FROM counts
  UNION ALL
  SELECT names, ns, list_transform(range(1, len(ns) + 1), lambda i: quota[i] + CASE WHEN i = list_position(list_transform(range(1, len(ns) + 1), lambda j: ns[j] - quota[j]), list_max(list_transform(range(1, len(ns) + 1), lambda j: ns[j] - quota[j]))) THEN 1 ELSE 0 END), lacking - 1 FROM rounds WHERE lacking > 0
)
SELECT unnest(names) AS o_orderstatus, unnest(quota)::BIGINT AS n_rows FROM rounds WHERE lacking = 0
""",
    "sample_k": f"SELECT vec_id, label FROM embeddings ORDER BY {_key(0, 'sample')}, vec_id LIMIT 40",
    "sample_bernoulli": f"SELECT vec_id, label FROM embeddings WHERE {_uniform(0, 'bernoulli')} < 0.2",
    "split_stratified_round": f"SELECT vec_id, label, r <= round_even(n * 0.25, 0) AS picked FROM {_R}",
    "split_largest_remainder": f"""WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY 1),
q AS (SELECT label, floor(77 * n / t) AS base, 77 * n / t - floor(77 * n / t) AS rest FROM c),
f AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= 77 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT vec_id, label FROM {_R} JOIN f USING (label) WHERE r <= quota""",
    "draw_per_class": f"SELECT vec_id, label FROM {_R} WHERE r <= 5",
    "nested_children": f"SELECT vec_id, label FROM embeddings ORDER BY {_key(0, 'sample')}, vec_id LIMIT 30",
    "kfold": f"SELECT vec_id, label, ((row_number() OVER (PARTITION BY CASE WHEN n >= 4 THEN label END ORDER BY {_key(0, 'fold')}, vec_id) - 1) % 4)::INT AS fold FROM {_R}",
    "chunk_shard": "SELECT label, unnest(range(CASE WHEN n % 16 >= 8 THEN n // 16 + 1 ELSE n // 16 END))::INT AS chunk, least(16, n - 16 * chunk) AS n_rows FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
    "balanced_rows": f"WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY {_key(0, 'balanced')}, vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings), t AS (SELECT vec_id, unnest(range((2800 // n + 1)::INT)) * n + place AS slot FROM p) SELECT (slot // 400)::INT AS estimator, vec_id FROM t WHERE slot < 2800",
    "split_by_date": "SELECT CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'train' WHEN o_orderdate < DATE '1997-01-01' THEN 'validation' ELSE 'test' END AS part, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
}
