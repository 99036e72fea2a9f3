"""Samples, splits and quotas. Every choice follows the order of a key that depends on seed, stream and row alone, so it is the same at any partitioning, and smaller draws are parts of larger ones."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.keys import key, uniform
from tessera.operators.ranks import numbered, numbered_within

#: Classes at most where their quotas are literals.
MOST_CLASSES = 10_000
#: Quotas up to this are met by each task's first rows of a class (Spark's windowGroupLimitThreshold).
FEW = 1000


def k_from_percent(n: int, percent: float) -> int:
    """percent of n rows, halves up, at least 1 and at most n."""
    return min(n, max(1, math.floor(n * percent / 100 + 0.5)))


def sample_k(df: DataFrame, k: int, id_column: str, seed: int = 0, stream: str = "sample") -> DataFrame:
    """k rows without replacement, all if there are fewer: a distributed top-k."""
    return df.orderBy(key(seed, stream, id_column), id_column).limit(k)


def bernoulli(df: DataFrame, rate: float, id_column: str, seed: int = 0, stream: str = "bernoulli") -> DataFrame:
    return df.where(uniform(seed, stream, id_column) < rate)


def ranked(df: DataFrame, by: str | list[str], id_column: str, seed: int = 0, stream: str = "split") -> DataFrame:
    """df with rank (from 1) and n of its class, classes in key order. Places come from ranges, so a class that holds most rows is dealt out."""
    classes = [by] if isinstance(by, str) else list(by)
    keyed = df.withColumns({"__u": uniform(seed, stream, id_column), "__key": key(seed, stream, id_column)})
    placed = numbered_within(keyed, classes, ["__u", "__key", id_column], "rank").select(*df.columns, "rank")
    sizes = df.groupBy(*classes).agg(F.count(F.lit(1)).alias("n")).select(*(F.col(c).alias(f"__class{i}") for i, c in enumerate(classes)), "n")
    same = F.lit(True)
    for i, c in enumerate(classes):
        same = same & F.col(c).eqNullSafe(F.col(f"__class{i}"))
    return placed.join(sizes, same).select(*df.columns, "rank", "n")


def first_ranked(df: DataFrame, by: str, most: int, id_column: str, seed: int = 0, stream: str = "split") -> DataFrame:
    """df with rank (see ranked), of each class the first `most` rows. Where these are few, a task sends on no more of a class, so the other rows aren't shuffled."""
    if most > FEW:
        return ranked(df, by, id_column, seed, stream).drop("n").where(F.col("rank") <= most)
    place = F.row_number().over(Window.partitionBy(by).orderBy("__key", id_column))
    return df.withColumn("__key", key(seed, stream, id_column)).withColumn("rank", place).where(F.col("rank") <= most).drop("__key")


def stratified(df: DataFrame, by: str, share: float, id_column: str, seed: int = 0) -> DataFrame:
    """df with picked: of each class the nearest whole number to share of its rows, halves to even."""
    return ranked(df, by, id_column, seed).withColumn("picked", F.col("rank") <= F.rint(F.col("n") * share)).drop("rank", "n")


def largest_remainder(counts: dict, total: int) -> dict:
    """Whole quotas in proportion to counts that add up to total; equal remainders go by class."""
    n = sum(counts.values())
    exact = {c: total * v / n for c, v in counts.items()} if n else dict.fromkeys(counts, 0.0)
    quota = {c: math.floor(x) for c, x in exact.items()}
    rest = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c is None, c))
    for c in rest[: min(total, n) - sum(quota.values())]:
        quota[c] += 1
    return quota


def capped_quotas(counts: dict, total: int) -> dict:
    """Equal quotas that no class exceeds its count by; what a class can't take goes to the class with most room."""
    quota = {c: min(total // max(1, len(counts)), v) for c, v in counts.items()}
    while sum(quota.values()) < min(total, sum(counts.values())):
        c = max(sorted(counts, key=lambda c: (c is None, c)), key=lambda c: counts[c] - quota[c])
        quota[c] += 1
    return quota


def quota_sql(quota: dict, by: str) -> Column:
    """The quota of a row's class, 0 for others; a null class has its own."""
    known = {c: q for c, q in quota.items() if c is not None}
    found = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col(by)) if known else F.lit(None)
    return F.when(F.col(by).isNull(), F.lit(quota.get(None, 0))).otherwise(F.coalesce(found, F.lit(0)))


def class_counts(df: DataFrame, by: str) -> dict:
    """Rows of each class, null among them; classes are MOST_CLASSES at most."""
    found = df.groupBy(by).count().limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{by} has more than {MOST_CLASSES} classes")
    return {r[0]: r[1] for r in found}


def take_quota(df: DataFrame, by: str, quota: dict, id_column: str, seed: int = 0) -> DataFrame:
    return first_ranked(df, by, max(quota.values(), default=0), id_column, seed).where(F.col("rank") <= quota_sql(quota, by)).drop("rank")


def exact_split(df: DataFrame, by: str, total: int, id_column: str, seed: int = 0) -> DataFrame:
    """Exactly total rows (all if fewer), classes in proportion by largest remainders."""
    return take_quota(df, by, largest_remainder(class_counts(df, by), total), id_column, seed)


def per_class(df: DataFrame, by: str, c: int, id_column: str, seed: int = 0) -> DataFrame:
    """c rows of each class; the draw for a smaller c is part of it."""
    return first_ranked(df, by, c, id_column, seed).drop("rank")


def folds(df: DataFrame, by: str, k: int, id_column: str, seed: int = 0) -> DataFrame:
    """df with fold (0 to k - 1), dealt round within each class; rows of classes smaller than k are dealt as one class."""
    small = df.groupBy(by).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") < k).select(F.col(by).alias("__small"), F.lit(True).alias("__few"))
    found = df.join(small, F.col(by).eqNullSafe(F.col("__small")), "left").withColumn("__class", F.when(F.col("__few").isNull(), F.col(by).cast("string"))).select(*df.columns, "__class")
    return ranked(found, "__class", id_column, seed, "fold").withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("__class", "rank", "n")


def chunks(df: DataFrame, by: str, most: int, least: int, id_column: str, seed: int = 0) -> DataFrame:
    """df with chunk: shuffled runs of at most `most` rows within a class; a last run shorter than `least` goes."""
    found = ranked(df, by, id_column, seed, "chunk").withColumn("chunk", F.floor((F.col("rank") - 1) / most).cast("int"))
    size = F.least(F.lit(most), F.col("n") - F.col("chunk") * most)
    return found.where((size == most) | (size >= least)).drop("rank", "n")


def balanced_rows(df: DataFrame, estimators: int, size: int, id_column: str, seed: int = 0) -> DataFrame:
    """(estimator, row): each estimator's rows are `size` consecutive places of one shuffled cycle over all rows, so each row serves equally often, give or take one.
    """
    n = df.count()
    if not n:
        return df.select(F.lit(0).alias("estimator"), id_column).limit(0)
    keyed = df.select(id_column, key(seed, "balanced", id_column).alias("__key")).withColumn("__u", F.conv(F.substring("__key", 1, 8), 16, 10).cast("double"))
    placed = numbered(keyed, ["__u", "__key", id_column], "place").select(id_column, (F.col("place") - 1).alias("place"))
    turns = math.ceil(estimators * size / n)
    cycle = placed.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: t.cast("long") * n + F.col("place"))))
    return cycle.where(F.col("slot") < estimators * size).select(F.floor(F.col("slot") / size).cast("int").alias("estimator"), id_column)


def replayed(df: DataFrame, id_column: str, size: int) -> DataFrame:
    """df with batch and place: rows in order of a numeric identifier in batches of `size`, the last batch filled up from the first rows, once."""
    n = df.count()
    if not n:
        return df.select("*", F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("place"))
    placed = numbered(df, [id_column], "place").withColumn("place", F.explode(F.array(F.col("place") - 1, F.col("place") - 1 + n)))
    return placed.where(F.col("place") < -(-n // size) * size).withColumn("batch", F.floor(F.col("place") / size))


def lpt_packing(costs: dict[str, float], bins: int) -> list[list[str]]:
    """Jobs over bins, longest first, each to the bin with the least so far."""
    heap = [(0.0, b) for b in range(bins)]
    out: list[list[str]] = [[] for _ in range(bins)]
    for job in sorted(costs, key=lambda j: (-costs[j], j)):
        load, b = heapq.heappop(heap)
        out[b].append(job)
        heapq.heappush(heap, (load + costs[job], b))
    return out
