"""Queries of neighbour scores on embeddings; queries are the rows whose identifier is divisible by 25, but for label spreading, which takes all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keys import uniform
from tessera.operators import neighbours as nb
from tessera.operators import spreading
from tessera.operators.loops import cut
from tessera.sources.tables import table

E = {"id_column": "vec_id", "vector": "embedding"}


def _e(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _q(spark, sf_dir):
    return _e(spark, sf_dir).where("vec_id % 25 = 0")


def _own(spark, sf_dir):
    return _q(spark, sf_dir).select(F.col("vec_id").alias("query"), F.col("label").alias("own"))


def _near(spark, sf_dir, k=10, metric="euclidean"):
    return nb.knn(_e(spark, sf_dir), _q(spark, sf_dir), k, metric=metric, carry=("label",), **E)


def knn_topk(spark, sf_dir):
    return _near(spark, sf_dir).select("query", F.col("rank").cast("int").alias("rank"), "neighbour", F.round("distance", 5).alias("distance"))


def knn_cosine(spark, sf_dir):
    return _near(spark, sf_dir, 5, "cosine").select("query", F.col("rank").cast("int").alias("rank"), "neighbour", F.round("distance", 5).alias("distance"))


def hub_scores(spark, sf_dir):
    return nb.hub_scores(_near(spark, sf_dir)).select("query", F.round("score", 5).alias("score"))


def neighbour_agreement(spark, sf_dir):
    return nb.agreement(_near(spark, sf_dir), _own(spark, sf_dir)).select("query", F.round("disagreement", 5).alias("disagreement"))


def knn_vote(spark, sf_dir):
    return nb.vote(_near(spark, sf_dir)).select("query", "label", F.round("share", 5).alias("share"))


def knn_relabel(spark, sf_dir):
    return nb.relabelled(_near(spark, sf_dir), _own(spark, sf_dir), 0.4)


def boundary_margin(spark, sf_dir):
    return nb.boundary_margin(_near(spark, sf_dir)).select("query", "first", F.round("margin", 4).alias("margin"))


def nearest_other_class(spark, sf_dir):
    found = nb.nearest_other_class(_e(spark, sf_dir), _q(spark, sf_dir), 3, label="label", classes=list(range(10)), **E)
    return found.select("query", "own", "label", F.round("distance", 5).alias("distance"))


def knn_shapley(spark, sf_dir):
    found = nb.knn(_e(spark, sf_dir), _q(spark, sf_dir), None, carry=("label",), mean_of=nb.shapley_values(4), **E)
    return found.select("neighbour", F.round("value", 6).alias("value"))


def label_spreading(spark, sf_dir):
    """Every fourth row of the table is a seed."""
    rows = _e(spark, sf_dir)
    near = cut(nb.knn(rows, rows, 5, carry=("label",), square=True, **E))
    seeds = rows.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query"), "label")
    found = nb.spread_labels(near, seeds, rounds=3)
    return found.groupBy("query").agg(F.round(F.sum("weight"), 6).alias("weight"))


def label_spreading_solved(spark, sf_dir):
    """The same seeds, spread to the end."""
    rows = _e(spark, sf_dir)
    near = cut(nb.knn(rows, rows, 5, square=True, **E))
    seeds = rows.select(F.col("vec_id").alias("query"), F.when(F.col("vec_id") % 4 == 0, F.col("label")).alias("label"))
    found = spreading.solved(seeds, near, list(range(10)), accuracy=1e-6)
    return found.select("query", F.round(F.array_max("probs"), 4).alias("top"))


def flip_random(spark, sf_dir):
    """Other labels for one row in ten, each of the nine alike."""
    rows = _e(spark, sf_dir).where(uniform(0, "pick", "vec_id") < 0.1)
    r = F.floor(uniform(0, "other", "vec_id") * 9).cast("int")
    return rows.select("vec_id", "label", (r + F.when(r >= F.col("label"), 1).otherwise(0)).alias("flipped"))


def flip_hub(spark, sf_dir):
    """The queries with the least mean distance lose their label to the next class."""
    top = nb.hub_scores(_near(spark, sf_dir)).orderBy("score", "query").limit(5)
    return top.join(_own(spark, sf_dir), "query").select("query", "own", ((F.col("own") + 1) % 10).alias("flipped"))


def flip_delta_replay(spark, sf_dir):
    """Cells and labels saved as differences, put back on the clean table."""
    clean = _e(spark, sf_dir).select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    delta = clean.where("vec_id % 9 = 0").select("vec_id", F.lit(0.25).alias("dx"), ((F.col("label") + 3) % 10).alias("new"))
    return clean.join(delta, "vec_id", "left").select("vec_id", F.round(F.col("x") + F.coalesce("dx", F.lit(0.0)), 6).alias("x"), F.coalesce("new", "label").alias("label"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_cosine, hub_scores, neighbour_agreement, knn_vote, knn_relabel, boundary_margin, nearest_other_class, knn_shapley, label_spreading, label_spreading_solved, flip_random, flip_hub, flip_delta_replay)}
_D = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE, 2))))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}.embedding[i]::DOUBLE * {b}.embedding[i]::DOUBLE))"
_COS = f"1 - {_DOT.format(a='q', b='c')} / (sqrt({_DOT.format(a='q', b='q')}) * sqrt({_DOT.format(a='c', b='c')}))"


def _pairs(k, d=_D, where="true"):
    return f"(SELECT * FROM (SELECT q.vec_id AS query, q.label AS own, c.vec_id AS neighbour, c.label AS label, {d} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0 AND {where}) WHERE rank <= {k})"


_KEY = "('0x' || substr(md5('0|{s}|' || vec_id), 1, 8))::BIGINT / 4294967296.0"
_VOTE = f"(SELECT query, own, label, n, n / sum(n) OVER (PARTITION BY query) AS share, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS r FROM (SELECT query, own, label, count(*) AS n FROM {_pairs(10)} GROUP BY 1, 2, 3))"
ORACLES = {
    "knn_topk": f"SELECT query, rank::INT AS rank, neighbour, round(distance, 5) AS distance FROM {_pairs(10)}",
    "knn_cosine": f"SELECT query, rank::INT AS rank, neighbour, round(distance, 5) AS distance FROM {_pairs(5, _COS)}",
    "hub_scores": f"SELECT query, round(avg(distance), 5) AS score FROM {_pairs(10)} GROUP BY 1",
    "neighbour_agreement": f"SELECT query, round(1 - avg((label = own)::INT), 5) AS disagreement FROM {_pairs(10)} GROUP BY 1",
    "knn_vote": f"SELECT query, label, round(share, 5) AS share FROM {_VOTE} WHERE r = 1",
    "knn_relabel": f"SELECT query, own, CASE WHEN share >= 0.4 THEN label ELSE own END AS new FROM {_VOTE} WHERE r = 1",
    "boundary_margin": f"WITH p AS {_pairs(10)}, m AS (SELECT quantile_disc(distance, 0.5) AS m FROM p), w AS (SELECT query, label, sum(exp(-distance / m)) AS w FROM p, m GROUP BY 1, 2), r AS (SELECT query, label, w / sum(w) OVER (PARTITION BY query) AS w, row_number() OVER (PARTITION BY query ORDER BY w DESC, label) AS r FROM w) SELECT query, max(CASE WHEN r = 1 THEN label END) AS first, round(max(CASE WHEN r = 1 THEN w END) - coalesce(max(CASE WHEN r = 2 THEN w END), 0), 4) AS margin FROM r GROUP BY 1",
    "nearest_other_class": f"SELECT query, own, label, round(d, 5) AS distance FROM (SELECT query, own, label, avg(distance) AS d, row_number() OVER (PARTITION BY query ORDER BY avg(distance), label) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY distance, neighbour) AS i FROM {_pairs(1 << 62, where='q.label <> c.label')}) WHERE i <= 3 GROUP BY 1, 2, 3) WHERE r = 1",
    "knn_shapley": f"SELECT neighbour, round(avg(s), 6) AS value FROM (SELECT neighbour, sum(t) OVER (PARTITION BY query ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, CASE WHEN nxt IS NULL THEN m / rank * least(1, rank / 4) ELSE (m - nxt) / 4 * least(4, rank) / rank END AS t FROM (SELECT *, (label = own)::INT::DOUBLE AS m, lead((label = own)::INT::DOUBLE) OVER (PARTITION BY query ORDER BY rank) AS nxt FROM {_pairs(1 << 62)}))) GROUP BY 1",
    "flip_random": f"SELECT vec_id, label, (r + (r >= label)::INT)::INT AS flipped FROM (SELECT vec_id, label, floor({_KEY.format(s='other')} * 9)::INT AS r FROM embeddings WHERE {_KEY.format(s='pick')} < 0.1)",
    "flip_hub": f"SELECT query, own, (own + 1) % 10 AS flipped FROM (SELECT query, own, avg(distance) AS s FROM {_pairs(10)} GROUP BY 1, 2 ORDER BY s, query LIMIT 5)",
    "flip_delta_replay": "SELECT vec_id, round(embedding[1]::DOUBLE + CASE WHEN vec_id % 9 = 0 THEN 0.25 ELSE 0 END, 6) AS x, CASE WHEN vec_id % 9 = 0 THEN (label + 3) % 10 ELSE label END AS label FROM embeddings",
}
