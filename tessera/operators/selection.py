"""Selections by class, weight, score and distance. Places within a class come from ranges, so a class that holds most rows is dealt out; classes are few and their quotas literals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import key, uniform
from tessera.operators.ranks import numbered, numbered_within
from tessera.operators.sampling import class_counts, folds, largest_remainder, quota_sql


def shuffled_within(df: DataFrame, by: str, id_column: str, seed: int = 0, stream: str = "split", into: str = "place") -> DataFrame:
    """df with each row's place from 1 in the key order of its class."""
    keyed = df.withColumns({"__u": uniform(seed, stream, id_column), "__key": key(seed, stream, id_column)})
    return numbered_within(keyed, [by], ["__u", "__key", id_column], into).drop("__u", "__key")


def _falling(column: str) -> Column:
    """A number that ascends as the column falls, null and NaN last."""
    return F.coalesce(-F.col(column).cast("double"), F.lit(float("nan")))


_quota = quota_sql


def take_share(df: DataFrame, by: str, n: int, id_column: str, seed: int = 0, balanced: bool = False) -> DataFrame:
    """About n rows: of each class its nearest whole share of n (halves to even), or as many of each; of more than n those with the least identifiers."""
    counts = class_counts(df, by)
    rows = sum(counts.values())
    quota = {c: n // len(counts) if balanced else round(n * v / rows) for c, v in counts.items()}
    out = shuffled_within(df, by, id_column, seed).where(F.col("place") <= _quota(quota, by)).drop("place")
    if sum(min(q, counts[c]) for c, q in quota.items()) <= n:
        return out
    return numbered(out, [id_column], "__place").where(F.col("__place") <= n).drop("__place")


def top_k_mask(df: DataFrame, score: str, k: int, id_column: str) -> DataFrame:
    """df with mask: 0 for the k lowest scores, ties to the earlier identifier, 1 for the rest."""
    return numbered(df, [score, id_column], "__place").withColumn("mask", (F.col("__place") > k).cast("int")).drop("__place")


def one_shot(df: DataFrame, confidence: str, predicted: str, rule: str, x: float, id_column: str) -> DataFrame:
    """df with kept: confidence above x (thr), the most confident share x of all rows (top) or of each predicted class (cls), ties by identifier. Null confidences come last."""
    if rule == "thr":
        return df.withColumn("kept", F.coalesce(F.col(confidence) > x, F.lit(False)))
    falling = df.withColumn("__down", _falling(confidence))
    if rule == "top":
        size = round(x * df.count())
        return numbered(falling, ["__down", id_column], "__place").withColumn("kept", F.col("__place") <= size).drop("__place", "__down")
    if rule != "cls":
        raise ValueError(f"unknown rule {rule!r}")
    counts = class_counts(df, predicted)
    quota = largest_remainder(counts, round(x * sum(counts.values())))
    return numbered_within(falling, [predicted], ["__down", id_column], "__place").withColumn("kept", F.col("__place") <= _quota(quota, predicted)).drop("__place", "__down")


def keep_by_weight(df: DataFrame, weight: str, by: str, keep: int, strategy: str, id_column: str) -> DataFrame:
    """Exactly `keep` rows (all if fewer) of the largest weight, ties by identifier: of all rows (global), or of each class in proportion to its rows or equally (proportional, balanced), what classes lack going to the largest weights of the rest. Null weights come last."""
    falling = df.withColumn("__down", _falling(weight))
    if strategy == "global":
        return numbered(falling, ["__down", id_column], "__place").where(F.col("__place") <= keep).drop("__place", "__down")
    if strategy not in ("proportional", "balanced"):
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = class_counts(df, by)
    n = sum(counts.values())
    quota = {c: min(round(keep * v / n) if strategy == "proportional" else keep // len(counts), v) for c, v in counts.items()}
    first = numbered_within(falling, [by], ["__down", id_column], "__place").withColumn("__rest", (F.col("__place") > _quota(quota, by)).cast("int")).drop("__place")
    return numbered(first.withColumn("__first", F.col("__rest").cast("double")), ["__first", "__down", id_column], "__place").where(F.col("__place") <= keep).select(*df.columns)


def reserved_quotas(counts: dict, total: int) -> dict:
    """Quotas that add up to total: one a class, the others in proportion by largest remainders, equal ones by class."""
    if total < len(counts):
        raise ValueError(f"{total} rows are fewer than {len(counts)} classes")
    rest, n = total - len(counts), sum(counts.values())
    exact = {c: v / n * rest for c, v in counts.items()}
    quota = {c: math.floor(x) + 1 for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (-(exact[c] - math.floor(exact[c])), c is None, c))[: total - sum(quota.values())]:
        quota[c] += 1
    return quota


def round_robin(df: DataFrame, by: str, estimators: int, total: int, id_column: str, seed: int = 0) -> DataFrame:
    """(estimator, row): each estimator takes reserved quotas; a class's rows serve in turn round its shuffled cycle, so equally often, give or take one, and repeat where the quota exceeds them."""
    counts = class_counts(df, by)
    quota = reserved_quotas(counts, total)
    q, n = _quota(quota, by).cast("long"), _quota(counts, by).cast("long")
    placed = shuffled_within(df.select(id_column, by), by, id_column, seed, "robin").withColumns({"__q": q, "__n": n})
    last = F.floor((F.col("__q") * estimators - F.col("place")) / F.col("__n"))
    slots = placed.where(F.col("place") <= F.col("__q") * estimators).withColumn("__slot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: t * F.col("__n") + F.col("place") - 1)))
    return slots.select(F.floor(F.col("__slot") / F.col("__q")).cast("int").alias("estimator"), id_column)


def local_draw(df: DataFrame, by: str, vector: str, anchor: list[float], total: int, id_column: str) -> DataFrame:
    """Of each class its rows nearest to the anchor, as many as its share of total by largest remainders; ties by identifier, rows without a distance last. Standardise the vectors first."""
    d = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, anchor)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    quota = largest_remainder(class_counts(df, by), total)
    return numbered_within(df.withColumn("__d", F.coalesce(d, F.lit(float("nan")))), [by], ["__d", id_column], "__place").where(F.col("__place") <= _quota(quota, by)).select(*df.columns)


def imbalanced_draw(df: DataFrame, by: str, total: int, minor: object, minor_n: int, id_column: str, seed: int = 0) -> DataFrame:
    """total rows of which minor_n are of the class `minor`: the other classes keep their shares of total, and further rows of them fill up what is left, in key order."""
    counts = class_counts(df, by)
    quota = largest_remainder(counts, total) | {minor: min(minor_n, counts.get(minor, 0))}
    extra = total - sum(quota.values())
    placed = shuffled_within(df, by, id_column, seed, "imbalanced", "__place")
    first = placed.withColumn("__late", F.when(F.col("__place") <= _quota(quota, by), 0.0).when(F.col(by) == F.lit(minor), 2.0).otherwise(1.0)).where("__late < 2")
    if extra <= 0:
        return first.where("__late = 0").select(*df.columns)
    rest = first.withColumns({"__u": uniform(seed, "imbalanced", id_column), "__key": key(seed, "imbalanced", id_column)})
    return numbered(rest, ["__late", "__u", "__key", id_column], "__n").where(F.col("__n") <= total).select(*df.columns)


def default_split(df: DataFrame, by: str, id_column: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with part: test, a share of all rows, val, that share of the rest, and train, each stratified by largest remainders; parts round up."""
    counts = class_counts(df, by)
    test = largest_remainder(counts, math.ceil(sum(counts.values()) * share))
    rest = {c: v - test[c] for c, v in counts.items()}
    val = largest_remainder(rest, math.ceil(sum(rest.values()) * share))
    place, t = F.col("__place"), _quota(test, by)
    part = F.when(place <= t, "test").when(place <= t + _quota(val, by), "val").otherwise("train")
    return shuffled_within(df, by, id_column, seed, "default", "__place").withColumn("part", part).drop("__place")


def positional_split(df: DataFrame, id_column: str, cut: int) -> DataFrame:
    """df with part: train for the first `cut` rows in order of the identifier, test for the others."""
    return numbered(df, [id_column], "__place").withColumn("part", F.when(F.col("__place") <= cut, "train").otherwise("test")).drop("__place")


#: Rows up to which a tuning holdout has a share and a number of folds; beyond, 0.2 and 1.
TUNING_BANDS = ((2_000, 0.1, 10), (5_000, 0.2, 5), (10_000, 0.2, 3), (20_000, 0.2, 2), (50_000, 0.3, 1))


def tuning_defaults(n: int) -> tuple[float, int]:
    """The share held out for tuning and the number of folds for n rows."""
    return next(((s, k) for most, s, k in TUNING_BANDS if n <= most), (0.2, 1))


def tuning_splits(df: DataFrame, id_column: str, share: float, splits: int = 1, by: str | None = None, seed: int = 0) -> DataFrame:
    """(split, row) for the rows held out by each of the first `splits` of 1/share folds, two at least: stratified by a class, or dealt round in key order."""
    k = max(2, round(1 / round(share, 2)))
    if by is not None:
        dealt = folds(df, by, k, id_column, seed)
    else:
        keyed = df.withColumns({"__u": uniform(seed, "tuning", id_column), "__key": key(seed, "tuning", id_column)})
        dealt = numbered(keyed, ["__u", "__key", id_column], "__place").withColumn("fold", ((F.col("__place") - 1) % k).cast("int"))
    return dealt.where(F.col("fold") < splits).select(F.col("fold").alias("split"), id_column)
