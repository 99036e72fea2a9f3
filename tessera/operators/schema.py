"""Column pipelines: coercion and alignment of types, infinities carried around transforms, permutations, masks and steps in a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import quantiles

INF = float("inf")
#: Polynomials in 1 / sqrt(n) of the two outermost Shapiro-Wilk weights, beyond their constants.
LAST_WEIGHT = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157)
NEXT_WEIGHT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)


def unique_names(names: Sequence[str]) -> list[str]:
    """Names made unique: a repeated one gets _1, _2 and so on, skipping names in use."""
    out: list[str] = []
    for n in names:
        new, k = n, 0
        while new in out or (k and new in names):
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def coerced(df: DataFrame) -> DataFrame:
    """Booleans and numbers as doubles, everything else as text."""
    number = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*(F.col(c).cast("int").cast("double").alias(c) if k == "boolean" else F.col(c).cast("double").alias(c) if k in number or k.startswith("decimal") else F.col(c).cast("string").alias(c) for c, k in df.dtypes))


def aligned(df: DataFrame, fitted: Sequence[tuple[str, str]]) -> DataFrame:
    """The fitted columns in their types; what doesn't parse is missing, a column that lacks is null."""
    have = set(df.columns)
    return df.select(*(F.col(c).try_cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in fitted))


def around_infinities(df: DataFrame, columns: Sequence[str], step: Callable[[DataFrame], DataFrame], descendants: dict[str, str] | None = None) -> DataFrame:
    """step on df with infinities as nulls; they return to the columns and to the step's new columns that descend from them (new -> old)."""
    marked = df.withColumns({f"__inf_{c}": F.when(F.abs(c) == INF, F.signum(c)) for c in columns}).withColumns({c: F.when(F.abs(c) < INF, F.col(c)) for c in columns})
    out = step(marked)
    back = {c: c for c in columns if c in out.columns} | (descendants or {})
    return out.withColumns({new: F.when(F.col(f"__inf_{old}").isNotNull(), F.col(f"__inf_{old}") * F.lit(INF)).otherwise(F.col(new)) for new, old in back.items()}).drop(*(f"__inf_{c}" for c in columns))


def rotated(columns: Sequence[str], by: int) -> list[str]:
    k = by % len(columns) if columns else 0
    return [*columns[k:], *columns[:k]]


def latin_square(n: int) -> list[list[int]]:
    """n permutations of n places; each place has each value once."""
    return [[(i + j) % n for j in range(n)] for i in range(n)]


def feature_subsets(columns: Sequence[str], estimators: int, size: int, most: int = 32) -> list[list[str]]:
    """Subsets of `size` columns in turn round a cycle, so that each serves equally often; estimators rise, to `most`, until all are covered."""
    n = len(columns)
    needed = -(-n // max(1, min(size, n)))
    count = min(max(estimators, needed), max(most, estimators))
    return [[columns[(i * size + j) % n] for j in range(min(size, n))] for i in range(count)]


def select_features(values: Column, flags: Column, width: int) -> Column:
    """The flagged entries of an array, left-aligned and padded with zeros to width."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), flags.alias("f")), lambda x: x["f"]), lambda x: x["v"])
    return F.concat(kept, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(kept)))


def without_constants(df: DataFrame, batch: str, values: str, width: int) -> DataFrame:
    """df with the entries of an array of `width` that vary within their batch, left-aligned and padded with zeros, and n_features, how many those are. One aggregate a batch makes the flags; a null array stays null."""
    at = lambda i: F.get(values, F.lit(i))
    flags = df.groupBy(F.col(batch).alias("__batch")).agg(F.array(*(F.coalesce(F.min(at(i)) < F.max(at(i)), F.lit(False)) for i in range(width))).alias("__flags"))
    joined = df.join(flags, F.col(batch).eqNullSafe(F.col("__batch")))
    kept = F.when(F.col(values).isNotNull(), select_features(F.col(values), F.col("__flags"), width))
    return joined.withColumns({values: kept, "n_features": F.size(F.filter("__flags", lambda f: f))}).select(*df.columns, "n_features")


def bucket(x: Column, borders: Sequence[float]) -> Column:
    """How many borders lie below x: its place among sorted borders."""
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < x))


def same_format(a: DataFrame, b: DataFrame) -> bool:
    """Columns agree in name, order and type, and both hold as many rows."""
    return a.dtypes == b.dtypes and a.count() == b.count()


def weighted_moments(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """mean sum(wx) / sum(w), and deviation from sum(w (x - mean)^2) / (sum(w) - 1)."""
    x, w = F.col(value), F.col(weight)
    s = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return s.select(*by, mean.alias("mean"), F.when(F.col("w") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("wxx") - F.col("w") * mean * mean) / (F.col("w") - 1)))).alias("std"))


@dataclass
class Pipeline:
    """Steps in a row; each has fit(df) -> state and transform(df, state) -> df. States are kept by fit and used by transform."""

    steps: Sequence[tuple[str, Callable[[DataFrame], object], Callable[[DataFrame, object], DataFrame]]]
    states: dict[str, object] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> DataFrame:
        for name, fit, transform in self.steps:
            self.states[name] = fit(df)
            df = transform(df, self.states[name])
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for name, _, transform in self.steps:
            if name not in self.states:
                raise ValueError(f"step {name} isn't fitted")
            df = transform(df, self.states[name])
        return df


def normality(values: np.ndarray) -> float:
    """The Shapiro-Wilk statistic by the usual polynomials in 1 / sqrt(n); 1 for fewer than four or equal values."""
    x = np.sort(np.asarray(values, dtype=float))
    n, spread = len(x), float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0
    if n < 4 or spread == 0:
        return 1.0
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / np.sqrt(n)
    a = m / np.sqrt((m**2).sum())
    last = np.polyval([*LAST_WEIGHT, a[-1]], u)
    if n > 5:
        before = np.polyval([*NEXT_WEIGHT, a[-2]], u)
        scale = np.sqrt(((m**2).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2))
        w = np.concatenate([[-last, -before], m[2:-2] / scale, [before, last]])
    else:
        scale = np.sqrt(((m**2).sum() - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        w = np.concatenate([[-last], m[1:-1] / scale, [last]])
    return float((w * x).sum() ** 2 / spread)


def shape_tags(df: DataFrame, columns: Sequence[str], few: int = 10, sample: int = 3000) -> dict[str, str]:
    """Per column from one aggregate and its median over finite values: ordinal (under `few` values), skewed_pos_1_0, skewed_pos, skewed (to the right), normal or other.

    Skew is 3 (mean - median) / deviation, above 1.1. Normal columns have a Shapiro-Wilk statistic above 0.95
    on `sample` rows, those with the least hash.
    """
    df = df.select(*(F.when(F.abs(F.col(c).cast("double")) < INF, F.col(c).cast("double")).alias(c) for c in columns))
    rows = df.orderBy(F.xxhash64(*columns)).limit(sample).collect()
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.count_distinct(c).alias(f"u{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"d{i}")]
    r = df.agg(*parts).first()
    medians = quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    out = {}
    for i, c in enumerate(columns):
        skewed = bool(r[f"d{i}"]) and 3 * (r[f"m{i}"] - medians[c][0]) / r[f"d{i}"] > 1.1
        low, high = r[f"a{i}"], r[f"b{i}"]
        out[c] = "ordinal" if r[f"u{i}"] < few else "skewed_pos_1_0" if skewed and low is not None and low >= 0 and high <= 1 else "skewed_pos" if skewed and low is not None and low > 0 else "skewed" if skewed else "normal" if normality([v[i] for v in rows if v[i] is not None]) > 0.95 else "other"
    return out
