"""Reports about experiments and labels, distances and projections of vectors, and metrics by name."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.digests import first_words
from tessera.operators import metrics as m

#: Rows whose digests are made together.
BATCH = 1 << 15


def noise_sweep(runs: DataFrame, dataset: str, rate: str, value: str, clean: float = 0.0) -> DataFrame:
    """dataset, rate, n, mean, std (of the sample; null for one run) and change: the mean less the dataset's mean at the clean rate."""
    a = runs.groupBy(dataset, rate).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    base = a.where(F.col(rate) == clean).select(dataset, F.col("mean").alias("__clean"))
    return a.join(base, dataset, "left").select(dataset, rate, "n", "mean", F.when(F.col("n") > 1, F.col("std")).alias("std"), (F.col("mean") - F.col("__clean")).alias("change"))


def repair_share(method: Column, poisoned: Column, oracle: Column, floor: float = 0.02) -> tuple[Column, Column]:
    """(method - poisoned) / (oracle - poisoned), null for a gap under 1e-12; and whether the gap is too small (under floor of |poisoned|) for the share to be stable."""
    gap = oracle - poisoned
    tiny = F.abs(gap) < 1e-12
    return F.when(~tiny, (method - poisoned) / F.when(~tiny, gap)), tiny | (F.abs(gap) < floor * F.abs(poisoned))


def no_skill(df: DataFrame, label: str) -> DataFrame:
    """metric, value of the predictor that gives the class shares: accuracy, balanced_accuracy, mcc, roc_auc, ce."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    row = row.where("k > 0")
    values = {"accuracy": F.col("top") / F.col("all"), "balanced_accuracy": 1 / F.col("k"), "mcc": F.lit(0.0), "roc_auc": F.lit(0.5), "ce": F.ln("all") - F.col("nln") / F.col("all")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()))).alias("x")).select("x.*")


def significance_order(scores: DataFrame, intervals: DataFrame, method: str = "method", score: str = "score") -> DataFrame:
    """place, method, score and relation to the next lower method: = for equal scores (to nine digits), > where the paired interval of their difference excludes 0, else ~; null for the last.

    intervals: a, b, low, high for each pair of methods in either order. Equal scores go by name. A row a method.
    """
    one = Window.orderBy(F.desc("s"), method)  # a row a method
    s = scores.select(method, score, F.round(score, 9).alias("s"))
    s = s.withColumns({"place": F.row_number().over(one), "next": F.lead(method).over(one), "s2": F.lead("s").over(one)})
    pairs = intervals.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"), (~F.coalesce((F.col("low") <= 0) & (F.col("high") >= 0), F.lit(True))).alias("__apart"))
    found = s.join(pairs, (F.least(method, "next") == F.col("__a")) & (F.greatest(method, "next") == F.col("__b")), "left")
    relation = F.when(F.col("next").isNull(), F.lit(None).cast("string")).when(F.col("s") == F.col("s2"), "=").when(F.col("__apart"), ">").otherwise("~")
    return found.select("place", method, score, relation.alias("relation"))


def label_stats(df: DataFrame, kept: str, given: str, poisoned: str, true: str, label: str) -> DataFrame:
    """n_kept, share_kept, label_acc, kept_wrong_share, kept_pois_share and repaired of a repair: kept rows with the labels it gives them. Shares of no kept rows are null. Given labels that are null count as wrong."""
    k = F.coalesce(F.col(kept), F.lit(False))
    ok = F.coalesce(F.col(label) == F.col(true), F.lit(False))
    bad = F.coalesce(F.col(poisoned), F.lit(False))
    removed = F.count_if(~k & bad)
    return df.agg(
        F.count_if(k).alias("n_kept"),
        F.avg(k.cast("double")).alias("share_kept"),
        F.avg(F.when(k, ok.cast("double"))).alias("label_acc"),
        (1 - F.avg(F.when(k, ok.cast("double")))).alias("kept_wrong_share"),
        F.avg(F.when(k, bad.cast("double"))).alias("kept_pois_share"),
        F.count_if(k & bad & ok).alias("repaired"),
        F.count_if(k & ok & (F.col(given) != F.col(label))).alias("relabelled"),
        m.ratio(removed.cast("double"), F.count_if(~k).cast("double"), None).alias("removal_precision"),
        m.ratio(removed.cast("double"), F.count_if(bad).cast("double"), None).alias("removal_recall"),
    )


def distance(a: Column | str, b: Column | str, norm: str) -> Column:
    """Linf or L2 between two arrays."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if norm == "Linf":
        return F.array_max(d)
    if norm != "L2":
        raise ValueError(f"norm must be Linf or L2, got {norm}")
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))


def projected(candidate: str, origin: str, eps: float, norm: str) -> Column:
    """candidate moved into the ball of radius eps around origin."""
    if norm == "Linf":
        return F.zip_with(candidate, origin, lambda x, o: F.least(F.greatest(x, o - eps), o + eps))
    n = distance(candidate, origin, norm)
    scale = F.least(F.lit(eps), n) / (n + 1e-12)
    return F.zip_with(candidate, origin, lambda x, o: o + (x - o) * scale)


def paired(clean: DataFrame, attacked: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Each attacked row (one or more an id) beside its clean row: clean_<column>, attacked_<column>."""
    a = clean.select(id_column, *(F.col(c).alias(f"clean_{c}") for c in columns))
    return attacked.select(id_column, *(F.col(c).alias(f"attacked_{c}") for c in columns)).join(a, id_column)


def succeeded(df: DataFrame, input_column: str, success: str, order: str, most: int | None = None) -> DataFrame:
    """The candidates that met all objectives, of each input at most `most` with the least order."""
    hit = df.where(F.col(success))
    if most is None:
        return hit
    return hit.withColumn("__r", F.row_number().over(Window.partitionBy(input_column).orderBy(order))).where(F.col("__r") <= most).drop("__r")


def unsuccessful_inputs(df: DataFrame, input_column: str, success: str) -> DataFrame:
    """Inputs none of whose candidates met all objectives."""
    return df.groupBy(input_column).agg(F.coalesce(F.bool_or(success), F.lit(False)).alias("__any")).where(~F.col("__any")).drop("__any")


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.concat_batches(some)
            some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def pooled_means(df: DataFrame, draw: str, value: str, rounds: int, id_column: str, seed: int = 0) -> DataFrame:
    """round, mean: rows resampled within each draw by weights of Poisson counts keyed by round and row, means of the draws averaged.

    Weights are sampled row by row, so no draw is collected. An Arrow function makes the digests of a batch
    for one round after the other and adds them up by draw, so there is no row for each round and row.
    """
    steps, p, reached = [], 0.36787944117144233, 0.0
    for k in range(12):
        reached += p
        steps.append(np.uint32(math.ceil(reached * 2**32)))
        p /= k + 1
    heads = [f"{seed}|pooled|{r}".encode() for r in range(rounds)]
    kind = df.schema[draw].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, BATCH):
            coded = batch.column("draw").dictionary_encode(null_encoding="encode")
            code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.intp), len(coded.dictionary)
            values = batch.column("value")
            known = np.bincount(code, values.is_valid().to_numpy(zero_copy_only=False), n) > 0
            v = values.fill_null(0.0).to_numpy(zero_copy_only=False)
            for r, word in enumerate(first_words(heads, batch.column("tail").to_pylist())):
                w = np.zeros(len(word), np.int8)
                for step in steps:
                    w += (word >= step).view(np.int8)
                w = w.astype(float)
                weight = np.bincount(code, w, n).astype(np.int64)
                with np.errstate(invalid="ignore"):
                    w *= v
                s = np.bincount(code, w, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r, np.int32)), coded.dictionary, pa.array(s, mask=~known), pa.array(weight)], ["round", "draw", "s", "w"])

    tail = F.concat_ws("|", F.lit(""), F.col(draw).cast("string"), F.col(id_column).cast("string")).cast("binary")
    rows = df.select(F.col(draw).alias("draw"), F.col(value).cast("double").alias("value"), tail.alias("tail"))
    schema = StructType([StructField("round", IntegerType()), StructField("draw", kind), StructField("s", DoubleType()), StructField("w", LongType())])
    per = rows.mapInArrow(sums, schema).groupBy("round", "draw").agg(m.ratio(F.sum("s"), F.sum("w"), None).alias("m"))
    return per.groupBy("round").agg(F.avg("m").alias("mean"))


def least_common(df: DataFrame, column: str) -> int:
    """Rows of the rarest value, 0 without values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().agg(F.min("count")).first()[0] or 0


def configurations(features: Sequence, classes: Sequence, norms: Sequence, n: int, seed: int = 0) -> list[tuple]:
    """The first n of (features, classes, norm): pairs of the first two in the order of a key, each with all norms."""
    from hashlib import md5

    pairs = sorted(product(range(len(features)), range(len(classes))), key=lambda p: md5(f"{seed}|config|{p[0]}|{p[1]}".encode()).hexdigest())
    return [(features[i], classes[j], norm) for (i, j), norm in product(pairs, norms)][:n]


#: Metrics of predicted classes, from the counts of a binary table.
OF_CLASSES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc")


def scored(df: DataFrame, names: Sequence[str], probs: str, label: str) -> DataFrame:
    """metric, value for binary rows with an array of two probabilities: class metrics take the first most probable class, roc_auc, ap, ce and brier the probabilities. An unknown name raises."""
    rows = df.select(F.col(label).alias("y"), F.col(probs).alias("__probs"), F.get(probs, F.lit(1)).alias("score"), m.argmax(probs).alias("guess"))
    unknown = [n for n in names if n not in (*OF_CLASSES, "roc_auc", "ap", "ce", "brier")]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    parts = []
    if classes := [n for n in names if n in OF_CLASSES]:
        wide = m.from_counts(rows.agg(*m.confusion("guess", "y")))
        parts.append(wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in classes))).alias("x")).select("x.*"))
    if direct := [n for n in names if n in ("ce", "brier")]:
        wide = rows.agg(*((m.cross_entropy("__probs", "y") if n == "ce" else m.brier("score", "y")).alias(n) for n in direct))
        parts.append(wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in direct))).alias("x")).select("x.*"))
    for n in names:
        if n in ("roc_auc", "ap"):
            one = m.roc_auc(rows, "score", "y") if n == "roc_auc" else m.average_precision(rows, "score", "y")
            parts.append(one.select(F.lit(n).alias("metric"), F.col("auc" if n == "roc_auc" else "ap").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
