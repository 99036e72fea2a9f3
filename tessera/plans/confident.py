"""Queries of cross-fitting and confident learning over the embeddings, whose given label is turned where vec_id is divisible by 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import confident as cf
from tessera.sources.tables import table

FOLDS, WIDTH, CLASSES = 5, 64, list(range(10))


def _scored(spark, sf_dir):
    """vec_id, fold, given and probs to nine digits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.when(F.col("vec_id") % 6 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("given"))
    rows = cf.gaussian_out_of_fold(cf.dealt(e, FOLDS, "vec_id"), "x", "given", WIDTH, CLASSES, "vec_id")
    return rows.withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))


def out_of_fold_scores(spark, sf_dir):
    given = cf.given_place("given", CLASSES)
    return _scored(spark, sf_dir).select("vec_id", "fold", "given", F.round(F.get("probs", given), 6).alias("p_given"), F.round(F.array_max("probs"), 6).alias("p_top"))


def out_of_fold_metrics(spark, sf_dir):
    return cf.fold_metrics(_scored(spark, sf_dir), "given", CLASSES).select("fold", "n", F.round("accuracy", 6).alias("accuracy"), F.round("ce", 5).alias("ce"))


def confident_joint(spark, sf_dir):
    """The calibrated joint count, a row a cell; it is made from the whole table."""
    counts = cf.joint(_scored(spark, sf_dir), "given", CLASSES)
    return spark.createDataFrame([(g, k, n) for g, row in enumerate(counts) for k, n in enumerate(row)], "given int, likely int, n long")


def label_issues(spark, sf_dir):
    return cf.issues(_scored(spark, sf_dir), "given", CLASSES, "vec_id").select("vec_id", F.round("quality", 6).alias("quality"), "guess", "issue")


QUERIES = {f.__name__: f for f in (out_of_fold_scores, out_of_fold_metrics, confident_joint, label_issues)}

_OOF = """
WITH given AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, (CASE WHEN vec_id % 6 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS given, ((row_number() OVER (ORDER BY md5('0|fold|' || vec_id), vec_id) - 1) % 5)::INT AS fold FROM embeddings
), entries AS (
  SELECT fold, given, unnest(x) AS v, unnest(range(1, 65)) AS i FROM given
), own AS (
  SELECT fold, given, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM entries GROUP BY ALL
), total AS (
  SELECT given, i, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM own GROUP BY ALL
), learned AS (
  SELECT f.fold, t.given AS c, t.i, t.n - coalesce(o.n, 0) AS n, (t.s - coalesce(o.s, 0)) / (t.n - coalesce(o.n, 0)) AS m, (t.q - coalesce(o.q, 0)) / (t.n - coalesce(o.n, 0)) AS q
  FROM (SELECT DISTINCT fold FROM given) f, total t LEFT JOIN own o ON o.fold = f.fold AND o.given = t.given AND o.i = t.i WHERE t.n > coalesce(o.n, 0)
), models AS (
  SELECT fold, c, ln(any_value(n)) - sum(ln(greatest(1e-6, q - m * m))) / 2 AS constant, list(m ORDER BY i) AS mean, list(greatest(1e-6, q - m * m) ORDER BY i) AS spread FROM learned GROUP BY fold, c
), logs AS (
  SELECT vec_id, g.fold, given, c, constant - list_sum(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) * (x[i] - mean[i]) / spread[i])) / 2 AS l FROM given g JOIN models m ON m.fold = g.fold
), shares AS (
  SELECT vec_id, fold, given, c, exp(l - max(l) OVER w) / sum(exp(l - (SELECT max(z.l) FROM logs z WHERE z.vec_id = logs.vec_id))) OVER w AS p FROM logs WINDOW w AS (PARTITION BY vec_id)
), scored AS (
  SELECT vec_id, any_value(fold) AS fold, any_value(given) AS given, list(p ORDER BY c) AS p FROM (SELECT vec_id, fold, given, c, round(greatest(1e-6, p) / sum(greatest(1e-6, p)) OVER (PARTITION BY vec_id), 9) AS p FROM shares) GROUP BY vec_id
), limits AS (
  SELECT list(t ORDER BY given) AS t FROM (SELECT given, avg(p[given + 1]) AS t FROM scored GROUP BY given)
), placed AS (
  SELECT scored.*, list_position(list_transform(range(1, 11), lambda i: CASE WHEN p[i] >= t[i] THEN p[i] END), list_max(list_transform(range(1, 11), lambda i: CASE WHEN p[i] >= t[i] THEN p[i] END))) - 1 AS likely FROM scored, limits
), cells AS (
  SELECT g.given, k.likely, CASE WHEN g.given = k.likely THEN greatest(1, count(p.vec_id)) ELSE count(p.vec_id) END AS c, any_value(g.n) AS n
  FROM (SELECT given, count(*) AS n FROM scored GROUP BY 1) g, (SELECT unnest(range(10)) AS likely) k LEFT JOIN placed p ON p.given = g.given AND p.likely = k.likely GROUP BY 1, 2
), exact AS (
  SELECT given, likely, n, c / sum(c) OVER (PARTITION BY given) * n AS x FROM cells
), joint AS (
  SELECT given, likely::INT AS likely, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY given ORDER BY round(x - floor(x), 9) DESC, likely) <= n - sum(floor(x)) OVER (PARTITION BY given) THEN 1 ELSE 0 END)::BIGINT AS n FROM exact
)
"""
ORACLES = {
    "out_of_fold_scores": _OOF + "SELECT vec_id, fold, given, round(p[given + 1], 6) AS p_given, round(list_max(p), 6) AS p_top FROM scored",
    "out_of_fold_metrics": _OOF + "SELECT fold, count(*) AS n, round(avg((list_position(p, list_max(p)) = given + 1)::INT), 6) AS accuracy, round(avg(-ln(p[given + 1])), 5) AS ce FROM scored GROUP BY fold",
    "confident_joint": _OOF + "SELECT given, likely, n FROM joint",
    "label_issues": _OOF
    + """, ranked AS (
  SELECT s.vec_id, j.n, row_number() OVER (PARTITION BY j.given, j.likely ORDER BY s.p[j.given + 1] - s.p[j.likely + 1], s.vec_id) AS place FROM scored s JOIN joint j ON j.given = s.given AND j.likely <> j.given AND j.n > 0
)
SELECT vec_id, round(p[given + 1], 6) AS quality, (list_position(p, list_max(p)) - 1)::INT AS guess, (list_position(p, list_max(p)) <> given + 1 AND vec_id IN (SELECT vec_id FROM ranked WHERE place <= n)) AS issue FROM scored""",
}
