"""Queries of selections by class, weight, score and distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import selection as s
from tessera.sources.tables import table


def _e(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


def _sure(spark, sf_dir):
    """vec_id, label, conf: twentieths of the identifier, many tied."""
    return _e(spark, sf_dir).withColumn("conf", ((F.col("vec_id") * 31) % 20) / 20.0)


def take_natural(spark, sf_dir):
    return s.take_share(_e(spark, sf_dir), "label", 90, "vec_id")


def take_balanced(spark, sf_dir):
    return s.take_share(_e(spark, sf_dir), "label", 90, "vec_id", balanced=True)


def top_k_mask(spark, sf_dir):
    return s.top_k_mask(_sure(spark, sf_dir), "conf", 150, "vec_id").select("vec_id", "mask")


def one_shot_top(spark, sf_dir):
    return s.one_shot(_sure(spark, sf_dir), "conf", "label", "top", 0.3, "vec_id").where("kept").select("vec_id")


def one_shot_class(spark, sf_dir):
    return s.one_shot(_sure(spark, sf_dir), "conf", "label", "cls", 0.3, "vec_id").where("kept").select("vec_id", "label")


def one_shot_threshold(spark, sf_dir):
    return s.one_shot(_sure(spark, sf_dir), "conf", "label", "thr", 0.5, "vec_id").where("kept").select("vec_id")


def keep_proportional(spark, sf_dir):
    return s.keep_by_weight(_sure(spark, sf_dir), "conf", "label", 203, "proportional", "vec_id").select("vec_id")


def keep_global(spark, sf_dir):
    return s.keep_by_weight(_sure(spark, sf_dir), "conf", "label", 203, "global", "vec_id").select("vec_id")


def stratified_round_robin(spark, sf_dir):
    return s.round_robin(_e(spark, sf_dir), "label", 6, 200, "vec_id")


def local_draw(spark, sf_dir):
    """Rows nearest to the mean direction (1, 0, 0, 0) of the first four components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("v"))
    return s.local_draw(e, "label", "v", [1.0, 0.0, 0.0, 0.0], 120, "vec_id").select("vec_id", "label")


def imbalanced_draw(spark, sf_dir):
    return s.imbalanced_draw(_e(spark, sf_dir), "label", 120, 0, 5, "vec_id")


def default_split(spark, sf_dir):
    return s.default_split(_e(spark, sf_dir), "label", "vec_id")


def positional_split(spark, sf_dir):
    return s.positional_split(_e(spark, sf_dir), "vec_id", 320)


def tuning_splits(spark, sf_dir):
    return s.tuning_splits(_e(spark, sf_dir), "vec_id", 0.2, 2)


QUERIES = {f.__name__: f for f in (take_natural, take_balanced, top_k_mask, one_shot_top, one_shot_class, one_shot_threshold, keep_proportional, keep_global, stratified_round_robin, local_draw, imbalanced_draw, default_split, positional_split, tuning_splits)}

_C = "(SELECT label, count(*) AS m, sum(count(*)) OVER () AS total FROM embeddings GROUP BY 1)"
_SURE = "(SELECT vec_id, label, ((vec_id * 31) % 20) / 20.0 AS conf FROM embeddings)"


def _placed(stream, by="label"):
    return f"(SELECT vec_id, label, row_number() OVER (PARTITION BY {by} ORDER BY md5('0|{stream}|' || vec_id)) AS place FROM embeddings)"


def _remainders(counts, total):
    """label, m, q: quotas of total by largest remainders over a relation of label, m."""
    return f"(SELECT label, m, floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, label) <= t - sum(floor(x)) OVER ())::INT AS q FROM (SELECT label, m, {total} AS t, ({total}) * m / sum(m) OVER () AS x FROM {counts}))"


_COUNTS = "(SELECT label, count(*) AS m FROM embeddings GROUP BY 1)"
_N = "(SELECT count(*) FROM embeddings)"
_TEST = _remainders(_COUNTS, f"ceil({_N} * 0.2)::BIGINT")
_REST = f"(SELECT label, m - q AS m FROM {_TEST})"
_VAL = _remainders(_REST, f"ceil(({_N} - ceil({_N} * 0.2)) * 0.2)::BIGINT")
_IMBALANCED = f"(SELECT label, m, CASE WHEN label = 0 THEN least(5, m) ELSE q END AS q FROM {_remainders(_COUNTS, '120')})"
ORACLES = {
    "take_natural": f"SELECT vec_id, label FROM {_placed('split')} JOIN {_C} USING (label) WHERE place <= round_even(90 * m / total, 0) ORDER BY vec_id LIMIT 90",
    "take_balanced": f"SELECT vec_id, label FROM {_placed('split')} WHERE place <= 90 // (SELECT count(DISTINCT label) FROM embeddings) ORDER BY vec_id LIMIT 90",
    "top_k_mask": f"SELECT vec_id, (row_number() OVER (ORDER BY conf, vec_id) > 150)::INT AS mask FROM {_SURE}",
    "one_shot_top": f"SELECT vec_id FROM {_SURE} QUALIFY row_number() OVER (ORDER BY conf DESC, vec_id) <= round_even(0.3 * {_N}, 0)",
    "one_shot_class": f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, vec_id) AS r FROM {_SURE}) JOIN {_remainders(_COUNTS, f'round_even(0.3 * {_N}, 0)::BIGINT')} USING (label) WHERE r <= q",
    "one_shot_threshold": f"SELECT vec_id FROM {_SURE} WHERE conf > 0.5",
    "keep_proportional": f"SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, vec_id) AS r FROM {_SURE}) JOIN {_C} USING (label) QUALIFY row_number() OVER (ORDER BY (r > least(m, round_even(203 * m / total, 0)))::INT, conf DESC, vec_id) <= 203",
    "keep_global": f"SELECT vec_id FROM {_SURE} QUALIFY row_number() OVER (ORDER BY conf DESC, vec_id) <= 203",
    "stratified_round_robin": f"WITH c AS (SELECT label, m, m / sum(m) OVER () * (200 - count(*) OVER ()) AS x FROM {_COUNTS}), q AS (SELECT label, m, floor(x)::BIGINT + 1 + (row_number() OVER (ORDER BY x - floor(x) DESC, label) <= 200 - sum(floor(x) + 1) OVER ())::INT AS q FROM c) SELECT ((t * m + place - 1) // q)::INT AS estimator, vec_id FROM {_placed('robin')} JOIN q USING (label), (SELECT unnest(range(0, 1200)) AS t) WHERE t * m + place - 1 < q * 6",
    "local_draw": f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY pow(embedding[1]::DOUBLE - 1, 2) + pow(embedding[2]::DOUBLE, 2) + pow(embedding[3]::DOUBLE, 2) + pow(embedding[4]::DOUBLE, 2), vec_id) AS r FROM embeddings) JOIN {_remainders(_COUNTS, '120')} USING (label) WHERE r <= q",
    "imbalanced_draw": f"SELECT vec_id, label FROM {_placed('imbalanced')} JOIN {_IMBALANCED} USING (label) WHERE label <> 0 OR place <= q QUALIFY row_number() OVER (ORDER BY (place > q)::INT, md5('0|imbalanced|' || vec_id)) <= 120",
    "default_split": f"SELECT vec_id, p.label, CASE WHEN place <= t.q THEN 'test' WHEN place <= t.q + v.q THEN 'val' ELSE 'train' END AS part FROM {_placed('default')} p JOIN {_TEST} t ON p.label = t.label JOIN {_VAL} v ON p.label = v.label",
    "positional_split": "SELECT vec_id, label, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 320 THEN 'train' ELSE 'test' END AS part FROM embeddings",
    "tuning_splits": "SELECT f::INT AS split, vec_id FROM (SELECT vec_id, (row_number() OVER (ORDER BY md5('0|tuning|' || vec_id)) - 1) % 5 AS f FROM embeddings) WHERE f < 2",
}
