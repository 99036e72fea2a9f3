"""Queries of metrics: labels (quality against toxic, the score from the document's number) and logits from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as m
from tessera.sources.tables import table


#: Fixed values of the tuning grids: temperatures 0.60 to 1.40 by hundredths, 198 thresholds from 0.01 to 0.99 at equal distances.
TEMPERATURES = [t / 100 for t in range(60, 141)]
THRESHOLDS = [round(0.01 + 0.98 * k / 197, 12) for k in range(198)]


def _scored(spark, sf_dir):
    """doc_id, y (toxic), guess (1 - quality), score (tied tenths of a hash of doc_id)."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return l.select("doc_id", F.col("toxic").alias("y"), (1 - F.col("quality")).alias("guess"), (((F.col("doc_id") * 7919) % 97 + 20 * F.col("toxic")) / 120.0).alias("score"))


_L = "(SELECT doc_id, toxic AS y, 1 - quality AS guess, ((doc_id * 7919) % 97 + 20 * toxic) / 120.0 AS score FROM labels)"


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 8).alias("logits"))


_E = "(SELECT vec_id, label, list_transform(embedding[1:10], lambda v: v::DOUBLE * 8) AS x FROM embeddings)"
_SM = "list_transform(x, lambda v: exp((v - list_max(x)) / {t}) / list_sum(list_transform(x, lambda u: exp((u - list_max(x)) / {t}))))"


def binary_confusion(spark, sf_dir):
    found = m.from_counts(_scored(spark, sf_dir).agg(*m.confusion("guess", "y")))
    return found.select("tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc")))


def binary_auc(spark, sf_dir):
    return m.roc_auc(_scored(spark, sf_dir), "score", "y").select(F.round("auc", 6).alias("auc"))


def auc_by_group(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("g", F.col("doc_id") % 3)
    return m.roc_auc(rows, "score", "y", ["g"]).select("g", F.round("auc", 6).alias("auc"))


def average_precision(spark, sf_dir):
    return m.average_precision(_scored(spark, sf_dir), "score", "y").select(F.round("ap", 6).alias("ap"))


def precision_at_k(spark, sf_dir):
    return m.at_k(_scored(spark, sf_dir), "score", "y", 20, "doc_id").select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def binary_cross_entropy(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("y", F.array(1 - F.col("score"), F.col("score")).alias("probs"))
    return rows.agg(F.round(m.cross_entropy("probs", "y"), 6).alias("ce"), F.round(F.avg((m.argmax("probs") == F.col("y")).cast("double")), 6).alias("accuracy"))


def ece_bins(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.greatest("score", 1 - F.col("score")).alias("c"), ((F.col("score") >= 0.5).cast("int") == F.col("y")).alias("ok"))
    bins = m.calibration_bins(rows, "c", "ok")
    return bins.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def calibration_error(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.greatest("score", 1 - F.col("score")).alias("c"), ((F.col("score") >= 0.5).cast("int") == F.col("y")).alias("ok"))
    return m.calibration_error(m.calibration_bins(rows, "c", "ok")).select(F.round("ece", 6).alias("ece"))


def brier(spark, sf_dir):
    wrong = (F.col("score") >= 0.5).cast("int") != F.col("y")
    return _scored(spark, sf_dir).agg(F.round(m.brier("score", "y"), 6).alias("brier"), F.round(F.avg(F.when(wrong & (F.greatest("score", 1 - F.col("score")) > 0.8), 1.0).otherwise(0.0)), 6).alias("confident_errors"))


def detection_report(spark, sf_dir):
    """A detector's flags against the truth, overall and its recall by class."""
    rows = _scored(spark, sf_dir).withColumn("class", F.col("doc_id") % 4)
    found = m.from_counts(rows.groupBy("class").agg(*m.confusion("guess", "y")))
    return found.select("class", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(m.ratio(F.col("fp").cast("double"), F.col("fp") + F.col("tn")), 6).alias("false_removal"))


def subset_purity(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    kept = F.col("score") < 0.5
    return rows.agg(F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("y") == 1)).alias("poison_kept"), F.round(m.ratio(F.count_if(kept & (F.col("y") == 0)).cast("double"), F.count_if(kept)), 6).alias("purity"), F.count_if(~kept & (F.col("y") == 0)).alias("clean_discarded"))


def softmax_temperature(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    p = m.softmax("logits", 1.7)
    return rows.select("vec_id", m.argmax(p).alias("predicted"), F.round(F.array_max(p), 6).alias("top"))


def temperature_tuning(spark, sf_dir):
    found = m.temperatures(_logits(spark, sf_dir), "logits", "label", TEMPERATURES)
    return found.select("temperature", F.round("loss", 6).alias("loss"))


def threshold_sweep(spark, sf_dir):
    found = m.sweep(_scored(spark, sf_dir), "score", "y", THRESHOLDS)
    return found.select("threshold", "tp", "fp", "fn", "tn", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("f1", 6).alias("f1"))


def class_balance_reweight(spark, sf_dir):
    shares = [0.05 + 0.01 * k for k in range(10)]
    rows = _logits(spark, sf_dir).withColumn("p", m.softmax("logits"))
    return rows.select("vec_id", F.round(F.get(m.reweighted("p", shares), F.lit(3)), 6).alias("p3"))


def ensemble_average(spark, sf_dir):
    rows = _logits(spark, sf_dir).select((F.col("vec_id") % 20).alias("row"), m.softmax("logits").alias("p"))
    return m.ensemble_average(rows, "row", "p").select("row", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(9)), 6).alias("p9"))


def batch_statistics(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("p", m.softmax("logits"))
    return rows.agg(F.round(F.avg(F.get("p", F.col("label"))), 6).alias("mean_given"), F.round(F.min(F.get("p", F.col("label"))), 6).alias("min_given"), F.round(F.avg(m.margin("p")), 6).alias("margin"), F.round(F.avg(m.entropy("p")), 6).alias("entropy"))


def multiclass_mcc(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("label", m.argmax("logits").alias("predicted"))
    return m.multiclass_mcc(rows, "predicted", "label").select(F.round("mcc", 6).alias("mcc"))


def macro_auc(spark, sf_dir):
    """One class against the rest, averaged over classes with both sides."""
    rows = _logits(spark, sf_dir).select("label", F.posexplode("logits").alias("k", "s")).withColumn("y", (F.col("label") == F.col("k")).cast("int"))
    return m.roc_auc(rows, "s", "y", ["k"]).agg(F.round(F.avg("auc"), 6).alias("auc"))


def metric_deltas(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    both = m.from_counts(rows.withColumn("p", F.lit(0)).select((F.col("score") >= 0.5).cast("int").alias("a"), "guess", "y").select("y", F.explode(F.array(F.struct(F.lit("after").alias("when"), F.col("a").alias("p")), F.struct(F.lit("before").alias("when"), F.col("guess").alias("p")))).alias("x")).select("y", "x.*").groupBy("when").agg(*m.confusion("p", "y")))
    wide = both.groupBy().pivot("when", ["before", "after"]).agg(F.first("accuracy").alias("accuracy"), F.first("f1").alias("f1"))
    return wide.select(F.round(F.col("after_accuracy") - F.col("before_accuracy"), 6).alias("d_accuracy"), F.round(F.col("after_f1") - F.col("before_f1"), 6).alias("d_f1"))


def weighted_vote(spark, sf_dir):
    rows = _logits(spark, sf_dir).select((F.col("vec_id") % 25).alias("q"), "label", F.round(F.get("logits", F.lit(0)), 4).alias("w"))
    return m.vote(rows, "q", "label", "w").select("q", "label", F.round("w", 4).alias("w"))


def transaction_cost(spark, sf_dir):
    return _scored(spark, sf_dir).agg(*m.confusion("guess", "y")).select(F.round(m.transaction_cost(), 6).alias("cost"))


def cumulative_acceptance(spark, sf_dir):
    """Along ascending scores: share of rows and of positives accepted."""
    found = m.cumulative_shares(_scored(spark, sf_dir), "score", "y", "doc_id")
    return found.select("doc_id", F.round("accepted", 6).alias("accepted"), F.round("positives", 6).alias("positives"))


QUERIES = {f.__name__: f for f in (binary_confusion, binary_auc, auc_by_group, average_precision, precision_at_k, binary_cross_entropy, ece_bins, calibration_error, brier, detection_report, subset_purity, softmax_temperature, temperature_tuning, threshold_sweep, class_balance_reweight, ensemble_average, batch_statistics, multiclass_mcc, macro_auc, metric_deltas, weighted_vote, transaction_cost, cumulative_acceptance)}


def _div(a, b, empty="0"):
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE {empty} END"


def _counts(p, y="y"):
    return ", ".join(f"(count(*) FILTER ({p} = {a} AND {y} = {b})) AS {n}" for n, a, b in (("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1), ("tp", 1, 1)))


_BA = f"({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT)"
_F1, _ACC = _div("2 * tp", "2 * tp + fp + fn"), _div("tp + tn", "tp + tn + fp + fn")


def _auc(rows, by=""):
    keys = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"SELECT {sel}round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 6) AS auc FROM (SELECT *, rank() OVER ({keys} ORDER BY score) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}score) - 1) / 2 AS r FROM {rows}) {'GROUP BY ' + by if by else ''}"


ORACLES = {
    "binary_confusion": f"SELECT tn, fp, fn, tp, round({_ACC}, 6) AS accuracy, round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, round({_F1}, 6) AS f1, round({_BA}, 6) AS balanced_accuracy, round({_div('tp * tn - fp * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')}, 6) AS mcc FROM (SELECT {_counts('guess')} FROM {_L})",
    "binary_auc": _auc(_L),
    "auc_by_group": _auc(f"(SELECT *, doc_id % 3 AS g FROM {_L})", "g"),
    "average_precision": f"SELECT round(sum(p * cp / cn) / sum(p), 6) AS ap FROM (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT score, sum(y) AS p, count(*) AS n FROM {_L} GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "precision_at_k": f"SELECT round(sum(y) / count(*), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM {_L}), 6) AS recall FROM (SELECT y FROM {_L} ORDER BY score DESC, doc_id LIMIT 20)",
    "binary_cross_entropy": f"SELECT round(-avg(ln(greatest(CASE WHEN y = 1 THEN score ELSE 1 - score END, 1e-12))), 6) AS ce, round(avg(((score > 1 - score)::INT = y)::INT), 6) AS accuracy FROM {_L}",
    "ece_bins": f"SELECT least(floor((c - 0.5) / 0.05), 9)::INT AS bin, count(*) AS n, round(avg(c), 6) AS confidence, round(avg(ok), 6) AS accuracy FROM (SELECT greatest(score, 1 - score) AS c, ((score >= 0.5)::INT = y)::INT AS ok FROM {_L}) GROUP BY 1",
    "calibration_error": f"SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT least(floor((c - 0.5) / 0.05), 9) AS bin, count(*) AS n, avg(c) AS c, avg(ok) AS a FROM (SELECT greatest(score, 1 - score) AS c, ((score >= 0.5)::INT = y)::INT AS ok FROM {_L}) GROUP BY 1)",
    "brier": f"SELECT round(avg(pow(score - y, 2)), 6) AS brier, round(avg(((score >= 0.5)::INT <> y AND greatest(score, 1 - score) > 0.8)::INT), 6) AS confident_errors FROM {_L}",
    "detection_report": f"SELECT class, tp, fp, round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('fp', 'fp + tn')}, 6) AS false_removal FROM (SELECT doc_id % 4 AS class, {_counts('guess')} FROM {_L} GROUP BY 1)",
    "subset_purity": f"SELECT count(*) FILTER (score < 0.5) AS kept, count(*) FILTER (score < 0.5 AND y = 1) AS poison_kept, round(count(*) FILTER (score < 0.5 AND y = 0) / count(*) FILTER (score < 0.5), 6) AS purity, count(*) FILTER (score >= 0.5 AND y = 0) AS clean_discarded FROM {_L}",
    "softmax_temperature": f"SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS predicted, round(list_max(p), 6) AS top FROM (SELECT vec_id, {_SM.format(t=1.7)} AS p FROM {_E})",
    "temperature_tuning": f"SELECT temperature, round(-avg(ln(greatest(exp((x[label + 1] - list_max(x)) / temperature) / list_sum(list_transform(x, lambda u: exp((u - list_max(x)) / temperature))), 1e-12))), 6) AS loss FROM {_E}, (SELECT unnest(range(60, 141)) / 100.0::DOUBLE AS temperature) GROUP BY 1",
    "threshold_sweep": f"SELECT threshold, tp, fp, fn, tn, round({_BA}, 6) AS balanced_accuracy, round({_F1}, 6) AS f1 FROM (SELECT threshold, {_counts('p')} FROM (SELECT y, threshold, (score >= threshold)::INT AS p FROM {_L}, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)) GROUP BY 1)",
    "class_balance_reweight": f"SELECT vec_id, round((p[4] / 0.08) / list_sum(list_transform(range(1, 11), lambda k: p[k] / (0.04 + 0.01 * k))), 6) AS p3 FROM (SELECT vec_id, {_SM.format(t=1)} AS p FROM {_E})",
    "ensemble_average": f"SELECT vec_id % 20 AS row, round(avg(p[1]), 6) AS p0, round(avg(p[10]), 6) AS p9 FROM (SELECT vec_id, {_SM.format(t=1)} AS p FROM {_E}) GROUP BY 1",
    "batch_statistics": f"SELECT round(avg(p[label + 1]), 6) AS mean_given, round(min(p[label + 1]), 6) AS min_given, round(avg(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2]), 6) AS margin, round(avg(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(10)), 6) AS entropy FROM (SELECT label, {_SM.format(t=1)} AS p FROM {_E})",
    "multiclass_mcc": f"WITH r AS (SELECT label, list_position(x, list_max(x)) - 1 AS p FROM {_E}), s AS (SELECT count(*)::DOUBLE AS s, sum((label = p)::INT)::DOUBLE AS c FROM r), a AS (SELECT p AS k, count(*)::DOUBLE AS n FROM r GROUP BY 1), b AS (SELECT label AS k, count(*)::DOUBLE AS n FROM r GROUP BY 1) SELECT round((c * s - (SELECT sum(a.n * b.n) FROM a JOIN b USING (k))) / sqrt((s * s - (SELECT sum(n * n) FROM a)) * (s * s - (SELECT sum(n * n) FROM b))), 6) AS mcc FROM s",
    "macro_auc": f"SELECT round(avg(a), 6) AS auc FROM (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS a FROM (SELECT k, (label = k)::INT AS y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS r FROM (SELECT label, unnest(range(10)) AS k, unnest(x) AS s FROM {_E})) GROUP BY k HAVING sum(y) > 0)",
    "metric_deltas": f"WITH a AS (SELECT {_counts('(score >= 0.5)::INT')} FROM {_L}), b AS (SELECT {_counts('guess')} FROM {_L}) SELECT round((SELECT {_ACC} FROM a) - (SELECT {_ACC} FROM b), 6) AS d_accuracy, round((SELECT {_F1} FROM a) - (SELECT {_F1} FROM b), 6) AS d_f1",
    "weighted_vote": f"SELECT q, label, round(w, 4) AS w FROM (SELECT q, label, w, row_number() OVER (PARTITION BY q ORDER BY w DESC, label) AS r FROM (SELECT vec_id % 25 AS q, label, sum(round(x[1], 4)) AS w FROM {_E} GROUP BY 1, 2)) WHERE r = 1",
    "transaction_cost": f"SELECT round((5.0 * (tp + fp) + 60.0 * fn) / 60.0, 6) AS cost FROM (SELECT {_counts('guess')} FROM {_L})",
    "cumulative_acceptance": f"SELECT doc_id, round(count(*) OVER w / count(*) OVER (), 6) AS accepted, round(sum(y) OVER w / sum(y) OVER (), 6) AS positives FROM {_L} WINDOW w AS (ORDER BY score, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}
