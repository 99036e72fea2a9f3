"""Synthetic columns from hashed uniforms and inverse distribution functions, class targets from numbers, and draws by temperature."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import uniform


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def normal(seed: int, stream: str, row: str = "row_id") -> Column:
    """Two uniforms by Box and Muller."""
    a, b = uniform(seed, f"{stream}/a", row), uniform(seed, f"{stream}/b", row)
    return F.sqrt(-2 * F.ln(F.greatest(a, F.lit(2.0**-33)))) * F.cos(2 * F.pi() * b)


def choice(seed: int, stream: str, shares: Sequence[float], row: str = "row_id") -> Column:
    """A class by its share."""
    total, at, u = sum(shares), 0.0, uniform(seed, stream, row)
    out = F.lit(len(shares) - 1)
    cases = []
    for k, s in enumerate(shares[:-1]):
        at += s / total
        cases.append((u < at, k))
    for test, k in reversed(cases):
        out = F.when(test, k).otherwise(out)
    return out


def zipf(seed: int, stream: str, exponent: float = 2.0, most: int = 10, row: str = "row_id") -> Column:
    return choice(seed, stream, [k**-exponent for k in range(1, most + 1)], row) + 1


def truncated_exponential(seed: int, stream: str, rate: float, high: float, row: str = "row_id") -> Column:
    u = uniform(seed, stream, row)
    return -F.ln(1 - u * F.lit(1 - math.exp(-rate * high))) / F.lit(rate)


def log_uniform(seed: int, stream: str, low: float, high: float, row: str = "row_id") -> Column:
    return F.lit(low) * F.pow(F.lit(high / low), uniform(seed, stream, row))


def circle(seed: int, stream: str, radius: float = 1.0, row: str = "row_id") -> tuple[Column, Column]:
    angle = 2 * F.pi() * uniform(seed, stream, row)
    return F.lit(radius) * F.cos(angle), F.lit(radius) * F.sin(angle)


def classes_by_rank(df: DataFrame, value: str, k: int) -> DataFrame:
    """df with class: how many of the k - 1 inner quantiles lie below the value; k = 2 cuts at the median."""
    q = df.agg(F.percentile(value, F.array(*(F.lit(i / k) for i in range(1, k)))).alias("q")).first().q or []
    return df.withColumn("class", F.size(F.filter(F.array(*map(F.lit, q)), lambda b: b < F.col(value))) if q else F.lit(0))


def permuted_classes(column: str, order: Sequence[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), F.col(column) + 1)


def by_temperature(probs: Column, temperature: float, u: Column) -> Column:
    """The class that u picks from probabilities raised to 1 / temperature."""
    hot = F.transform(probs, lambda p: F.pow(p, F.lit(1 / temperature)))
    total = F.aggregate(hot, F.lit(0.0), lambda a, v: a + v)
    sums = F.transform(F.sequence(F.lit(1), F.size(probs)), lambda i: F.aggregate(F.slice(hot, F.lit(1), i), F.lit(0.0), lambda a, v: a + v) / total)
    return F.least(F.size(F.filter(sums, lambda s: s <= u)), F.size(probs) - 1)


def valid_split(train: DataFrame, test: DataFrame, label: str) -> bool:
    """Both parts hold the same classes, two at least; classes are few."""
    a, b = ({r[0] for r in d.select(label).distinct().collect()} for d in (train, test))
    return a == b and len(a) > 1


ACTIVATIONS = {
    "sign": lambda x: F.signum(x),
    "step": lambda x: F.when(x >= 0, 1.0).otherwise(0.0),
    "bell": lambda x: F.exp(-x * x),
    "relu": lambda x: F.when(x > 0, x).otherwise(0.0),
    "softplus": lambda x: F.ln(1 + F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)),
    "tanh": lambda x: F.tanh(x),
    "square": lambda x: x * x,
    "root": lambda x: F.sqrt(F.abs(x)),
    "wave": lambda x: F.sin(x),
    "fraction": lambda x: x - F.floor(x),
    "nothing": lambda x: x,
}
