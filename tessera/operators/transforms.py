"""Fitted column transforms: one aggregate makes the state, a projection applies it. State is a row of numbers or short arrays, which become literals; nulls are skipped by fits and kept by projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tessera.operators.ranks import quantiles

TINY = 1e-6


@dataclass(frozen=True)
class Fitted:
    """A transform of columns with its state; `apply` gives the new column of each."""

    columns: tuple[str, ...]
    apply: Callable[[str], Column]
    state: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.apply(c) for c in self.columns})


def _fit(df: DataFrame, columns: list[str], parts: dict[str, Callable[[Column], Column]]) -> dict[str, dict[str, float]]:
    """One aggregate over all columns: {column: {part: value}}."""
    row = df.agg(*(f(F.col(c)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in parts.items())).first()
    return {c: {k: row[f"{i}_{k}"] for k in parts} for i, c in enumerate(columns)}


def _moments(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    return _fit(df, columns, {"mean": F.avg, "std": F.stddev_pop, "sample": F.stddev_samp, "low": F.min, "high": F.max})


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def standard(df: DataFrame, columns: list[str], limit: float = 100.0) -> Fitted:
    s = _moments(df, columns)
    return Fitted(tuple(columns), lambda c: clipped((F.col(c) - F.lit(s[c]["mean"])) / F.lit((s[c]["std"] or 0.0) + TINY), -limit, limit), s)


def sample_standard(df: DataFrame, columns: list[str], limit: float = 100.0) -> Fitted:
    """By the sample deviation, 1e-6 at least."""
    s = _moments(df, columns)
    return Fitted(tuple(columns), lambda c: clipped((F.col(c) - F.lit(s[c]["mean"])) / F.lit(max(s[c]["sample"] or 0.0, TINY)), -limit, limit), s)


def minmax(bounds: dict[str, tuple[float, float]]) -> Fitted:
    """From metadata; a range of zero counts as 1."""
    return Fitted(tuple(bounds), lambda c: (F.col(c) - F.lit(float(bounds[c][0]))) / F.lit(float(bounds[c][1] - bounds[c][0] or 1.0)), bounds)


def minmax_inverse(bounds: dict[str, tuple[float, float]]) -> Fitted:
    return Fitted(tuple(bounds), lambda c: F.col(c) * F.lit(float(bounds[c][1] - bounds[c][0] or 1.0)) + F.lit(float(bounds[c][0])), bounds)


def outlier_bounds(df: DataFrame, columns: list[str], threshold: float = 4.0) -> dict[str, tuple[float, float]]:
    """mean +- threshold deviations, fitted again on the values within the first such bounds."""
    first = _fit(df, columns, {"mean": F.avg, "std": F.stddev_samp})
    inside = {c: (v["mean"] - threshold * max(v["std"] or 0.0, TINY), v["mean"] + threshold * max(v["std"] or 0.0, TINY)) for c, v in first.items()}
    kept = df.select(*(F.when(F.col(c).between(*inside[c]), F.col(c)).alias(c) for c in columns))
    second = _fit(kept, columns, {"mean": F.avg, "std": F.stddev_samp})
    return {c: (v["mean"] - threshold * max(v["std"] or 0.0, TINY), v["mean"] + threshold * max(v["std"] or 0.0, TINY)) for c, v in second.items()}


def soft_clip(df: DataFrame, columns: list[str], threshold: float = 4.0) -> Fitted:
    """Values beyond the bounds grow by the logarithm of their size only."""
    b = outlier_bounds(df, columns, threshold)

    def apply(c: str) -> Column:
        grown = F.log1p(F.abs(F.col(c)))
        lower = F.greatest(F.lit(b[c][0]) - grown, F.col(c))
        return F.when(F.col(c).isNotNull(), F.least(F.lit(b[c][1]) + grown, lower))

    return Fitted(tuple(columns), apply, b)


def hard_clip(df: DataFrame, columns: list[str], threshold: float = 4.0) -> Fitted:
    b = outlier_bounds(df, columns, threshold)
    return Fitted(tuple(columns), lambda c: clipped(F.col(c), *b[c]), b)


def squash(df: DataFrame, columns: list[str], low: float = 0.25, high: float = 0.75, bound: float = 3.0) -> Fitted:
    """Centred at the median, over the quantile range (or half the whole range, or 0 for a constant), then bent into -bound to bound; infinities go there."""
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    s = _fit(df, columns, {"low": lambda x: F.min(finite(x)), "high": lambda x: F.max(finite(x))})
    q = quantiles(df, {c: finite(F.col(c)) for c in columns}, [low, 0.5, high])
    s = {c: s[c] | {"q": q[c]} for c in columns}

    def apply(c: str) -> Column:
        (a, m, b), lo, hi = s[c]["q"], s[c]["low"], s[c]["high"]
        scale = 1 / (b - a) if b > a else 2 / (hi - lo + 1e-38) if hi > lo else 0.0
        z = (F.col(c) - F.lit(float(m))) * F.lit(scale)
        return F.when(F.col(c) == float("inf"), bound).when(F.col(c) == -float("inf"), -bound).otherwise(z / F.sqrt(1 + F.pow(z / F.lit(bound), 2)))

    return Fitted(tuple(columns), apply, s)


def robust(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - median) over the quartile range, scaled to unit variance for normal data."""
    s = {c: {"q": q} for c, q in quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).items()}
    return Fitted(tuple(columns), lambda c: (F.col(c) - F.lit(float(s[c]["q"][1]))) / F.lit(float((s[c]["q"][2] - s[c]["q"][0]) / 1.3489795003921634 or 1.0)), s)


def quantile_levels(df: DataFrame, columns: list[str], n: int) -> dict[str, list[float]]:
    """n quantiles at equal distances of each column; n is bounded, so they are short literals."""
    return quantiles(df, {c: F.col(c) for c in columns}, [i / (n - 1) for i in range(n)])


def quantile_uniform(df: DataFrame, columns: list[str], n: int = 10, extrapolate: float | None = None) -> Fitted:
    """The empirical distribution function, linear between n quantiles. With extrapolate r values beyond go on along the first or last interval, to -r and 1 + r."""
    q = quantile_levels(df, columns, n)

    def apply(c: str) -> Column:
        v, x = q[c], F.col(c)
        if len(v) < 2 or v[0] == v[-1]:
            return F.when(x.isNotNull(), F.lit(0.0))
        out = F.when(x.isNull(), F.lit(None).cast("double"))
        left = next(b for b in v if b > v[0])
        right = next(a for a in reversed(v) if a < v[-1])
        below, above = F.lit(0.0), F.lit(1.0)
        if extrapolate is not None:
            step = (v.index(left)) / (n - 1)
            below = F.greatest(F.lit(-extrapolate), (x - F.lit(v[0])) / F.lit(left - v[0]) * F.lit(step))
            last = (n - 1 - (n - 1 - v[::-1].index(right))) / (n - 1)
            above = F.least(F.lit(1.0 + extrapolate), 1 + (x - F.lit(v[-1])) / F.lit(v[-1] - right) * F.lit(last))
        out = out.when(x < v[0], below).when(x > v[-1], above).when(x == v[0], 0.0).when(x == v[-1], 1.0)
        for i in range(n - 1):
            if v[i + 1] > v[i]:
                out = out.when(x <= v[i + 1], F.lit(i / (n - 1)) + (x - F.lit(v[i])) / F.lit((v[i + 1] - v[i]) * (n - 1)))
        return out

    return Fitted(tuple(columns), apply, q)


@pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The inverse of the normal distribution function, p kept 1e-7 from 0 and 1."""
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(min(max(v, 1e-7), 1 - 1e-7)), na_action="ignore")


def quantile_normal(df: DataFrame, columns: list[str], n: int = 10) -> Fitted:
    u = quantile_uniform(df, columns, n)
    return Fitted(u.columns, lambda c: normal_quantile(u.apply(c)), u.state)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / F.lit(power)
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / F.lit(2 - power)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, power: float) -> Column:
    return F.ln(x) if power == 0 else (F.pow(x, F.lit(power)) - 1) / F.lit(power)


def yeo_johnson_fit(df: DataFrame, column: str, powers: list[float] | None = None) -> float:
    """The power of a grid with the largest likelihood, all in one aggregate."""
    grid = powers or [i / 10 for i in range(-20, 41)]
    x = F.col(column).cast("double")
    row = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jacobian"), *(F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(grid))).first()
    likelihood = lambda i, p: -row.n / 2 * math.log(max(row[f"v{i}"] or 0.0, 1e-300)) + (p - 1) * (row.jacobian or 0.0)
    return max(enumerate(grid), key=lambda t: likelihood(*t))[1]


def power_search(df: DataFrame, columns: list[str], form: Callable[[Column, Column], Column], jacobian: Callable[[Column], Column], low: float, high: float, *, own: Callable[[Column], Column] = lambda x: x, tolerance: float = 1e-5, points: int = 21) -> dict[str, float]:
    """Per column the power between low and high with the largest likelihood, to `tolerance`: a grid of powers is one aggregate, and the next grid lies between the best one's neighbours. form(x, p) is the transformed value, jacobian(x) what p - 1 multiplies in its likelihood, own(x) the values that count.

    The table is read once for a column; the grids read its distinct values with their counts. A column without two values has power 1.
    """
    found = dict.fromkeys(columns, 1.0)
    for c in columns:
        counts = df.select(own(F.col(c).cast("double")).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("w")).persist()
        s = counts.agg(F.sum("w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("centre"), F.sum(F.col("w") * jacobian(F.col("x"))).alias("j")).first()
        a, b = low, high
        while s.n and s.high > s.low:
            grid = [a + (b - a) * k / (points - 1) for k in range(points)]
            tried = counts.select("x", "w", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "p"))
            z = tried.select("k", "w", (form(F.col("x"), F.col("p")) - form(F.lit(float(s.centre)), F.col("p"))).alias("z"))  # from the centre's value, so squares don't cancel
            rows = z.groupBy("k").agg(F.sum(F.col("w") * F.col("z")).alias("a"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("b")).collect()  # a row a power
            spreads = {r.k: r.b / s.n - (r.a / s.n) ** 2 for r in rows}
            if max(spreads.values()) <= 0:
                break
            best = max(range(points), key=lambda k: -s.n / 2 * math.log(max(spreads[k], 1e-300)) + (grid[k] - 1) * (s.j or 0.0))
            found[c] = grid[best]
            if grid[1] - grid[0] <= tolerance:
                break
            a, b = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
        counts.unpersist()
    return found


def yeo_johnson_powers(df: DataFrame, columns: list[str], low: float = -2.0, high: float = 4.0) -> dict[str, float]:
    """The powers of largest likelihood."""

    def form(x: Column, p: Column) -> Column:
        up = F.when(F.abs(p) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, p) - 1) / p)
        down = F.when(F.abs(p - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - p) - 1) / (2 - p))
        return F.when(x >= 0, up).otherwise(down)

    return power_search(df, columns, form, lambda x: F.signum(x) * F.log1p(F.abs(x)), low, high)


def box_cox_powers(df: DataFrame, columns: list[str], low: float = -2.0, high: float = 4.0) -> dict[str, float]:
    """The powers of largest likelihood over positive values."""

    def form(x: Column, p: Column) -> Column:
        return F.when(F.abs(p) < 1e-9, F.ln(x)).otherwise((F.pow(x, p) - 1) / p)

    return power_search(df, columns, form, F.ln, low, high, own=lambda x: F.when(x > 0, x))


def ordinal(df: DataFrame, columns: list[str], unknown: float | None = None) -> Fitted:
    """Sorted categories as 0, 1, ...; values not seen and nulls become `unknown`. Dictionaries are literals, for columns of few categories."""
    found = {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in columns}

    def apply(c: str) -> Column:
        place = F.array_position(F.array(*map(F.lit, found[c])), F.col(c)) if found[c] else F.lit(0)
        return F.when(place > 0, (place - 1).cast("double")).otherwise(F.lit(unknown))

    return Fitted(tuple(columns), apply, found)


def ordinal_join(df: DataFrame, column: str, into: str) -> DataFrame:
    """The same for columns of many categories: the dictionary is a table, ranks come from a distributed sort of the distinct values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    part = values.repartitionByRange(column).withColumn("__p", F.spark_partition_id()).persist()
    sizes = sorted((r["__p"], r["count"]) for r in part.groupBy("__p").count().collect())
    before, offset = {}, 0
    for p, n in sizes:
        before[p] = offset
        offset += n
    base = F.coalesce(*([F.when(F.col("__p") == p, F.lit(b)) for p, b in before.items()] or [F.lit(0)]))
    coded = part.withColumn(into, base + F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1).drop("__p")
    return df.join(coded, column, "left")


def one_hot(df: DataFrame, column: str, most: int = 30, drop_binary: bool = True) -> DataFrame:
    """A 0/1 column per category, one alone for two; unknown ones are 0 throughout."""
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} categories")
    kept = levels[1:] if drop_binary and len(levels) == 2 else levels
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in kept}).drop(column)


def imputed(df: DataFrame, columns: list[str], how: str = "median") -> Fitted:
    if how == "median":
        s = {c: {"v": q[0] if q else None} for c, q in quantiles(df, {c: F.col(c) for c in columns}, [0.5]).items()}
    else:
        s = _fit(df, columns, {"v": F.avg})
    return Fitted(tuple(columns), lambda c: F.coalesce(F.col(c), F.lit(s[c]["v"] if s[c]["v"] is not None else 0.0)), s)


def finite_or_mean(df: DataFrame, columns: list[str]) -> Fitted:
    """Infinities count as missing, and missing values become the mean."""
    own = lambda x: F.when(F.abs(x) < float("inf"), x)
    s = _fit(df, columns, {"v": lambda x: F.avg(own(x))})
    return Fitted(tuple(columns), lambda c: F.coalesce(own(F.col(c)), F.lit(s[c]["v"] if s[c]["v"] is not None else 0.0)), s)


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that aren't constant: two values, or a value and a null."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(e for i, c in enumerate(columns) for e in ((F.min(c) < F.max(c)).alias(f"d{i}"), F.count(c).alias(f"k{i}")))).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] or 0 < row[f"k{i}"] < row.n]


def unique_filter(df: DataFrame, columns: list[str], threshold: int = 1) -> list[str]:
    """Columns of more than threshold distinct values; all for tables that small, the first if none is left."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns))).first()
    return columns if row.n <= threshold else [c for i, c in enumerate(columns) if row[f"u{i}"] > threshold] or columns[:1]


def polynomial(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products of pairs of columns, each over its deviation."""
    used = sorted({c for p in pairs for c in p})
    s = _moments(df, used)
    scaled = {c: F.col(c) / F.lit(max(s[c]["std"] or 0.0, TINY)) for c in used}
    return df.withColumns({f"{a}_x_{b}": scaled[a] * scaled[b] for a, b in pairs})


def pearson_skew(x: Column) -> Column:
    """3 (mean - median) / deviation."""
    return F.when(F.stddev_pop(x) > 0, 3 * (F.avg(x) - F.percentile(x, 0.5)) / F.stddev_pop(x)).otherwise(0.0)


def svd_features(df: DataFrame, columns: list[str], k: int, id_column: str) -> DataFrame:
    """id_column with svd_0 .. of the columns over their deviations: the Gram matrix is one aggregate, its eigenvectors become literals."""
    s = _moments(df, columns)
    x = [F.coalesce(F.col(c), F.lit(0.0)) / F.lit(max(s[c]["std"] or 0.0, TINY)) for c in columns]
    n = len(columns)
    row = df.agg(*(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n))).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(gram)
    chosen = vectors[:, np.argsort(-values)[:k]]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), range(chosen.shape[1])])  # the largest entry is positive
    return df.select(id_column, *(reduce(lambda a, b: a + b, (x[i] * F.lit(float(chosen[i, j])) for i in range(n))).alias(f"svd_{j}") for j in range(chosen.shape[1])))


def canonical(c: str, kind: str) -> Column:
    """The text of a value for fingerprints: whole numbers alike in every numeric type, missing ones a mark."""
    if kind in ("double", "float"):
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), "\u0002").when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))
    return F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical texts in order."""
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\u0001", *(canonical(c, kinds[c]) for c in columns)), 256)
