"""Predicted distributions: bars over buckets, quantile functions, isotonic fits, and their scores.

Borders and levels are short arrays that are the same for all rows; a row has an array of
masses or quantiles. Closed forms are array functions; data-dependent merging and parametric
tails are Arrow functions over whole columns of arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def cumulative(a: Column) -> Column:
    """Running sums, as many as entries."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(a, F.lit(1), i)))


def bar_mean(mass: Column, borders: list[float]) -> Column:
    middles = literal([(a + b) / 2 for a, b in zip(borders, borders[1:])])
    return total(F.zip_with(mass, middles, lambda p, m: p * m))


def bar_variance(mass: Column, borders: list[float]) -> Column:
    second = literal([(a * a + a * b + b * b) / 3 for a, b in zip(borders, borders[1:])])
    return total(F.zip_with(mass, second, lambda p, m: p * m)) - F.pow(bar_mean(mass, borders), 2)


def bar_cdf(mass: Column, borders: list[float], y: Column) -> Column:
    """Mass below y, linear within a bucket."""
    shares = F.transform(literal(borders[:-1]), lambda a, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - a) / (F.get(literal(borders), i + 1) - a))))
    return total(F.zip_with(mass, shares, lambda p, s: p * s))


def bar_quantile(mass: Column, borders: list[float], q: Column) -> Column:
    """The least y with a mass of q below it, linear within its bucket."""
    before = F.transform(F.sequence(F.lit(0), F.lit(len(borders) - 2)), lambda i: F.aggregate(F.slice(mass, 1, i), F.lit(0.0), lambda s, v: s + v))
    pieces = F.arrays_zip(before.alias("b"), mass.alias("m"), literal(borders[:-1]).alias("lo"), literal(borders[1:]).alias("hi"))
    holding = F.filter(pieces, lambda x: (x["m"] > 0) & (x["b"] + x["m"] >= q - 1e-12))
    x = F.get(holding, F.lit(0))
    return F.when(F.size(holding) > 0, x["lo"] + (x["hi"] - x["lo"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (q - x["b"]) / x["m"]))).otherwise(F.lit(float(borders[-1])))


def bar_mode(mass: Column, borders: list[float]) -> Column:
    """The middle of the bucket with the most mass a width, the first of several."""
    width = literal([b - a for a, b in zip(borders, borders[1:])])
    density = F.zip_with(mass, width, lambda p, w: p / w)
    return F.element_at(literal([(a + b) / 2 for a, b in zip(borders, borders[1:])]), F.array_position(density, F.array_max(density)).cast("int"))


def bar_nll(mass: Column, borders: list[float], y: Column) -> Column:
    """-ln density at y, y drawn to the borders."""
    inside = F.greatest(F.lit(float(borders[0])), F.least(F.lit(float(borders[-1])), y))
    k = F.least(F.lit(len(borders) - 2), F.greatest(F.lit(0), F.size(F.filter(literal(borders), lambda b: b <= inside)) - 1))
    width = F.get(literal([b - a for a, b in zip(borders, borders[1:])]), k)
    return -F.ln(F.greatest(F.get(mass, k) / width, F.lit(1e-12)))


def exceedance(mass: Column, borders: list[float], y: float) -> Column:
    """Probability of improving on y."""
    return 1 - bar_cdf(mass, borders, F.lit(float(y)))


def expected_improvement(mass: Column, borders: list[float], y: float) -> Column:
    """E max(0, Y - y)."""
    gains = [((b - y) ** 2 - (max(a, y) - y) ** 2) / (2 * (b - a)) if b > y else 0.0 for a, b in zip(borders, borders[1:])]
    return total(F.zip_with(mass, literal(gains), lambda p, g: p * g))


def rebinned(mass: Column, borders: list[float], new: list[float]) -> Column:
    """Masses on other borders, by differences of the distribution function; what lies beyond counts to the first or last."""
    at = [bar_cdf(mass, borders, F.lit(float(b))) for b in new[1:-1]]
    edges = [F.lit(0.0), *at, F.lit(1.0) * total(mass)]
    return F.array(*(b - a for a, b in zip(edges, edges[1:])))


def equal_mass_borders(values: np.ndarray, buckets: int) -> list[float]:
    """Borders between equally many of the sorted values: the least, middles between groups, the greatest. Values that don't fill a last group go."""
    v = np.sort(values)
    size = len(v) // buckets
    v = v[: size * buckets]
    inner = [(v[i * size - 1] + v[i * size]) / 2 for i in range(1, buckets)]
    return [float(v[0]), *map(float, inner), float(v[-1])]


def pinball(quantiles: Column, levels: list[float], y: Column) -> Column:
    """Mean pinball loss over the levels."""
    losses = F.zip_with(quantiles, literal(levels), lambda q, a: F.greatest(a * (y - q), (a - 1) * (y - q)))
    return total(losses) / F.lit(float(len(levels)))


def crps(quantiles: Column, levels: list[float], y: Column) -> Column:
    """Twice the pinball loss integrated over the levels by trapezoids."""
    losses = F.zip_with(quantiles, literal(levels), lambda q, a: F.greatest(a * (y - q), (a - 1) * (y - q)))
    weights = np.zeros(len(levels))
    for i in range(len(levels) - 1):
        weights[i : i + 2] += (levels[i + 1] - levels[i]) / 2
    return 2 * total(F.zip_with(losses, literal(weights.tolist()), lambda v, w: v * w))


def monotone(quantiles: Column) -> Column:
    """Running maxima."""
    return F.transform(F.sequence(F.lit(1), F.size(quantiles)), lambda i: F.array_max(F.slice(quantiles, F.lit(1), i)))


def quantile_at(quantiles: Column, levels: list[float], a: float) -> Column:
    """The quantile function at level a, linear between levels; beyond them exponential tails whose scale continues the slope at the outermost levels."""
    n = len(levels)
    if a < levels[0]:
        lo, hi = F.get(quantiles, F.lit(0)), F.get(quantiles, F.lit(1))
        return lo + (hi - lo) / F.lit(np.log(levels[1] / levels[0])) * F.lit(np.log(a / levels[0]))
    if a > levels[-1]:
        lo, hi = F.get(quantiles, F.lit(n - 2)), F.get(quantiles, F.lit(n - 1))
        return hi + (hi - lo) / F.lit(np.log((1 - levels[-2]) / (1 - levels[-1]))) * F.lit(np.log((1 - levels[-1]) / (1 - a)))
    k = min(max(int(np.searchsorted(levels, a, side="right")) - 1, 0), n - 2)
    lo, hi = F.get(quantiles, F.lit(k)), F.get(quantiles, F.lit(k + 1))
    return lo + (hi - lo) * F.lit((a - levels[k]) / (levels[k + 1] - levels[k]))


def pool_adjacent(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares."""
    w = np.ones(len(y)) if w is None else w
    level: list[list[float]] = []
    for v, k in zip(y, w):
        level.append([float(v), float(k), 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            b, a = level.pop(), level.pop()
            level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in level]) if level else np.zeros(0)


@pandas_udf(ArrayType(DoubleType()))
def isotonic(values: pd.Series) -> pd.Series:
    """pool_adjacent of each array; null stays null."""
    return values.map(lambda v: pool_adjacent(np.asarray(v, dtype=float)), na_action="ignore")
