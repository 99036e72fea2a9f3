"""Column steps that follow modalities: schemas and their algebra, cleaning to floats, reshaping of distributions by named presets, and pipelines of such steps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tessera.operators import transforms as t
from tessera.operators.ranks import even_quantiles, numbered, quantiles
from tessera.operators.schema import shape_tags, unique_names
from tessera.operators.tails import keyed_normal

#: Fixed value: the most quantiles that a preset fits, whatever the table's size.
MOST_LEVELS = 20_000

NUMERICAL, CATEGORICAL, TEXT, DATE, CONSTANT = "numerical", "categorical", "text", "date", "constant"


@dataclass(frozen=True)
class Schema:
    """Names and modalities of columns, in their order."""

    features: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.features]

    def of(self, *modalities: str) -> list[str]:
        return [n for n, m in self.features if m in modalities]

    def append(self, modality: str, names: Sequence[str]) -> Schema:
        """With further columns, their names made unique against all."""
        new = unique_names([*self.names, *names])[len(self.features) :]
        return Schema((*self.features, *((n, modality) for n in new)))

    def slice(self, places: Sequence[int]) -> Schema:
        return Schema(tuple(self.features[i] for i in places))

    def remove(self, places: Sequence[int]) -> Schema:
        gone = set(places)
        return Schema(tuple(f for i, f in enumerate(self.features) if i not in gone))

    def merged(self, places: Sequence[int], part: Schema) -> Schema:
        """With the columns at `places` as a step returned them, in that order."""
        out = list(self.features)
        for place, feature in zip(places, part.features, strict=True):
            out[place] = feature
        return Schema(tuple(out))


def on_columns(df: DataFrame, columns: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step's result with the columns in the order of df; columns that the step adds come last."""
    out = step(df)
    return out.select(*(c for c in df.columns if c in out.columns), *(c for c in out.columns if c not in df.columns))


def _number(c: str, kind: str) -> Column:
    """A column as a number: days and moments in seconds, texts as they are."""
    if kind == "date":
        return F.unix_date(c).cast("double") * 86_400
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6
    return F.col(c) if kind == "string" else F.col(c).cast("double")


def _parsed(value: Column, modality: str) -> Column:
    number = value.try_cast("double")
    return F.coalesce(number, value.try_cast("timestamp").cast("double")) if modality == DATE else number


def clean(df: DataFrame, schema: Schema, missing: Sequence[str] = ()) -> DataFrame:
    """The schema's columns as doubles: categories and texts as 0, 1, ... in sorted order, texts in `missing` and what doesn't parse as null, dates and timestamps as seconds since 1970, booleans as 0 and 1. Infinities stay. Other columns are kept.

    Dictionaries are tables, so columns of many categories are no literals.
    """
    out, kinds = df, dict(df.dtypes)
    for c, modality in schema.features:
        value = F.when(~F.col(c).isin(*missing), F.col(c)) if missing and kinds[c] == "string" else _number(c, kinds[c])
        if modality in (CATEGORICAL, TEXT):
            own, code = unique_names([*df.columns, "__value", "__code"])[-2:]
            distinct = df.select(value.alias(own)).where(F.col(own).isNotNull()).distinct()
            if kinds[c] == "string":
                coded = t.ordinal_join(distinct, own, code)
            else:
                coded = numbered(distinct, [own], code).withColumn(code, F.col(code) - 1)
            out = out.join(coded.select(own, code), value == F.col(own), "left").withColumn(c, F.col(code).cast("double")).drop(own, code)
        else:
            number = _number(c, kinds[c]) if kinds[c] != "string" else _parsed(value, modality)
            out = out.withColumn(c, F.when(~F.isnan(number), number))
    return out.select(*df.columns)


def numeric_encoded(df: DataFrame, schema: Schema, keep: Sequence[str] = ()) -> DataFrame:
    """`keep`, categories as codes (-1 if missing) and numbers with the mean for nulls; other modalities go."""
    numbers, categories = schema.of(NUMERICAL), schema.of(CATEGORICAL)
    coded = clean(df, Schema(tuple((c, CATEGORICAL) for c in categories))) if categories else df
    filled = t.imputed(coded, numbers, "mean").transform(coded) if numbers else coded
    return filled.select(*keep, *(F.coalesce(F.col(c), F.lit(-1.0)).alias(c) if m == CATEGORICAL else F.col(c) for c, m in schema.features if m in (NUMERICAL, CATEGORICAL)))


def standardised(f: t.Fitted, df: DataFrame) -> t.Fitted:
    """f, then (x - mean) / deviation of its results, which infinite ones don't enter."""
    own = lambda c: F.when(F.abs(f.apply(c)) < float("inf"), f.apply(c))
    row = df.agg(*(e for i, c in enumerate(f.columns) for e in (F.avg(own(c)).alias(f"m{i}"), F.stddev_pop(own(c)).alias(f"s{i}")))).first()
    s = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(f.columns)}
    return t.Fitted(f.columns, lambda c: (f.apply(c) - F.lit(s[c][0])) / F.lit(s[c][1]), s)


def _each(columns: Sequence[str], f: Callable[[Column], Column]) -> t.Fitted:
    return t.Fitted(tuple(columns), lambda c: f(F.col(c)), {})


def _finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with infinities as nulls."""
    return df.select(*(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in columns))


def _sparing(f: t.Fitted) -> t.Fitted:
    """f for finite values; infinite ones stay."""
    return t.Fitted(f.columns, lambda c: F.when(F.abs(F.col(c)) == float("inf"), F.col(c).cast("double")).otherwise(f.apply(c)), f.state)


def _power(df: DataFrame, columns: list[str]) -> t.Fitted:
    powers = t.yeo_johnson_powers(_finite(df, columns), columns)
    return _sparing(standardised(t.Fitted(tuple(columns), lambda c: t.yeo_johnson(F.col(c), powers[c]), powers), _finite(df, columns)))


def box_cox_fit(df: DataFrame, column: str, powers: list[float] | None = None) -> float:
    """The power of a grid with the largest likelihood over positive values, all in one aggregate."""
    grid = powers or [i / 10 for i in range(-20, 21)]
    x = F.when(F.col(column) > 0, F.col(column).cast("double"))
    row = df.agg(F.count(x).alias("n"), F.sum(F.ln(x)).alias("logs"), *(F.var_pop(t.box_cox(x, p)).alias(f"v{i}") for i, p in enumerate(grid))).first()
    likelihood = lambda i, p: -row.n / 2 * math.log(max(row[f"v{i}"] or 0.0, 1e-300)) + (p - 1) * (row.logs or 0.0)
    return max(enumerate(grid), key=lambda v: likelihood(*v))[1]


def _box(df: DataFrame, columns: list[str]) -> t.Fitted:
    """Box-Cox of the values scaled into 0.1 to 1, which makes every column positive; later values are drawn into that range."""
    df = _finite(df, columns)
    s = t._moments(df, columns)
    low = {c: s[c]["low"] if s[c]["low"] is not None else 0.0 for c in columns}
    width = {c: (s[c]["high"] - s[c]["low"] if s[c]["high"] is not None else 0.0) or 1.0 for c in columns}
    moved = lambda c: t.clipped(0.1 + 0.9 * (F.col(c) - F.lit(low[c])) / F.lit(width[c]), 0.1, 1.0)
    powers = t.box_cox_powers(df.select(*(moved(c).alias(c) for c in columns)), columns)
    return _sparing(standardised(t.Fitted(tuple(columns), lambda c: t.box_cox(moved(c), powers[c]), powers), df))


def _interpolated(xs: np.ndarray, ys: np.ndarray) -> Callable[[Column], Column]:
    """Linear between the points, constant beyond them."""

    @pandas_udf(DoubleType())
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v.astype("float64"), xs, ys), index=v.index).where(v.notna())

    return at


def kernel_integral(df: DataFrame, columns: list[str], alpha: float = 1.0, normal: bool = False, points: int = 201) -> t.Fitted:
    """The integral of a Gaussian density estimate with bandwidth alpha times the deviation, from 0 at the least to 1 at the largest value; normal: its normal quantile.

    The density is fitted to `points` quantiles of each column's finite values, so it is small at any size; nulls and infinities stay.
    """
    df = _finite(df, columns)
    levels = quantiles(df, {c: F.col(c) for c in columns}, [i / (points - 1) for i in range(points)])
    erf = np.vectorize(math.erf)
    curves = {}
    for c in columns:
        v = np.array(levels[c] or [0.0])
        width = alpha * float(v.std()) or 1.0
        grid = np.linspace(v[0], v[-1], 4 * points) if v[0] < v[-1] else v[:1]
        p = (0.5 * (1 + erf((grid[:, None] - v[None, :]) / (width * math.sqrt(2))))).mean(1)
        curves[c] = _interpolated(grid, (p - p[0]) / (p[-1] - p[0]) if p[-1] > p[0] else np.full(len(p), 0.5))
    out = lambda c: t.normal_quantile(curves[c](F.col(c))) if normal else curves[c](F.col(c))
    return _sparing(t.Fitted(tuple(columns), out, levels))


def adaptive(df: DataFrame, columns: list[str], most: int = MOST_LEVELS) -> t.Fitted:
    """By a column's shape: exp for skewed ones within 0 to 1, Box-Cox for positive ones, Yeo-Johnson for others, nothing for ordinal and normal ones, normal quantiles for the rest."""
    tags = shape_tags(df, columns)
    group = lambda tag: [c for c in columns if tags[c] == tag]
    fitted: dict[str, t.Fitted] = {}
    for tag, fit in (("skewed_pos_1_0", lambda c: _each(c, F.exp)), ("skewed_pos", lambda c: _box(df, c)), ("skewed", lambda c: _power(df, c)), ("ordinal", lambda c: _each(c, lambda x: x)), ("normal", lambda c: _each(c, lambda x: x)), ("other", lambda c: empirical(df, c, _levels(df, 10, most), normal=True))):
        if group(tag):
            f = fit(group(tag))
            fitted |= dict.fromkeys(group(tag), f)
    return t.Fitted(tuple(columns), lambda c: fitted[c].apply(c), tags)


def _levels(df: DataFrame, per: int, most: int) -> int:
    """One quantile for so many rows, 2 at least."""
    n = df.count()
    return max(1, min(max(n // per, 2 if per > 1 else 1), n, most))


def empirical(df: DataFrame, columns: list[str], n: int, normal: bool = False, beyond: float | None = None) -> t.Fitted:
    """The share of values below, linear between n quantiles, where several agree the middle of theirs; 0 and 1 at and beyond the ends, or with `beyond` on along the whole range, to -beyond and 1 + beyond. normal: its normal quantile. Nulls stay; infinities are beyond the ends."""
    levels = {c: np.maximum.accumulate(np.array(even_quantiles(_finite(df, [c]), F.col(c), n) or [0.0])) for c in columns}

    def curve(q: np.ndarray) -> Callable[[Column], Column]:
        refs = np.linspace(0, 1, len(q)) if len(q) > 1 else np.zeros(1)

        @pandas_udf(DoubleType())
        def at(v: pd.Series) -> pd.Series:
            x = v.to_numpy(dtype=float, na_value=np.nan)
            u = (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1])) / 2
            u = np.where(x >= q[-1], 1.0 if q[-1] > q[0] else 0.0, np.where(x <= q[0], 0.0, u))
            if beyond is not None and q[-1] > q[0]:
                share = (x - q[0]) / (q[-1] - q[0])
                u = np.where(x < q[0], np.maximum(share, -beyond), np.where(x > q[-1], np.minimum(share, 1 + beyond), u))
            return pd.Series(np.where(np.isnan(x), np.nan, u), index=v.index).where(v.notna())

        return at

    curves = {c: curve(q) for c, q in levels.items()}
    out = lambda c: t.normal_quantile(curves[c](F.col(c).cast("double"))) if normal else curves[c](F.col(c).cast("double"))
    return t.Fitted(tuple(columns), out, {c: q.tolist() for c, q in levels.items()})


def noisy_quantiles(df: DataFrame, columns: list[str], id_column: str, noise: float = 1e-3, most: int = 1000, normal: bool = True, seed: int = 0) -> t.Fitted:
    """empirical() with a quantile for every 30 rows, 10 to `most`, fitted to values that keyed Gaussian noise of `noise` over their deviation was added to, so that ties are parted; what is transformed gets no noise."""
    n = max(min(df.count() // 30, most), 10)
    deviations = _finite(df, columns).agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    width = {c: noise / max(deviations[c] or 0.0, noise) for c in columns} if noise else {}
    noisy = df.select(*((F.col(c) + F.lit(width[c]) * keyed_normal(seed, f"quantile|{c}", id_column)).alias(c) if noise else F.col(c) for c in columns))
    return empirical(noisy, columns, n, normal)


def _quantile(per: int, normal: bool, beyond: float | None = None) -> Callable:
    def fit(df: DataFrame, columns: list[str], most: int = MOST_LEVELS) -> t.Fitted:
        return empirical(df, columns, _levels(df, per, most), normal, beyond)

    return fit


#: Bandwidths of the kernel presets.
ALPHAS = (0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 5.0)

#: Transforms by name; each fits (df, columns) and gives one column for each.
PRESETS: dict[str, Callable[[DataFrame, list[str]], t.Fitted]] = {
    "none": lambda df, c: _each(c, lambda x: x),
    "log": lambda df, c: _each(c, F.ln),
    "1_plus_log": lambda df, c: _each(c, F.log1p),
    "exp": lambda df, c: _each(c, F.exp),
    "power": _power,
    "safepower": _power,
    "power_box": _box,
    "safepower_box": _box,
    "quantile_uni_coarse": _quantile(10, False),
    "quantile_norm_coarse": _quantile(10, True),
    "quantile_uni": _quantile(5, False),
    "quantile_norm": _quantile(5, True),
    "quantile_uni_fine": _quantile(1, False),
    "quantile_norm_fine": _quantile(1, True),
    "quantile_uni_extrapolate": _quantile(5, False, 1.0),
    "squashing_scaler_default": lambda df, c: t.squash(df, c),
    "squashing_scaler_max10": lambda df, c: t.squash(df, c, bound=10.0),
    "robust": t.robust,
    "adaptive": adaptive,
    "kdi": lambda df, c: kernel_integral(df, c, normal=True),
    "kdi_uni": lambda df, c: kernel_integral(df, c),
    **{f"kdi_alpha_{a}{'' if n else '_uni'}": lambda df, c, a=a, n=n: kernel_integral(df, c, a, n) for a in ALPHAS for n in (True, False)},
}


def reshaped(df: DataFrame, schema: Schema, preset: str, append: bool = False, categories: bool = False) -> tuple[DataFrame, Schema, dict[str, str]]:
    """df, its schema and the ancestors (new column -> source) after a preset on the numerical columns, and the categorical ones on request: in their place, or appended under <column>_<preset>.

    norm_and_kdi gives two columns for each: its normal quantile in place (or appended) and its kernel integral, appended. A column is no longer categorical once transformed.
    """
    if preset not in PRESETS and preset != "norm_and_kdi":
        raise ValueError(f"unknown preset {preset!r}")
    columns = schema.of(NUMERICAL, CATEGORICAL) if categories else schema.of(NUMERICAL)
    if not columns:
        return df, schema, {}
    fitted = [(PRESETS["quantile_norm_coarse"](df, columns), append, "norm"), (PRESETS["kdi_uni"](df, columns), True, "kdi")] if preset == "norm_and_kdi" else [(PRESETS[preset](df, columns), append, preset)]
    new, out, ancestors = {}, schema, {}
    for f, further, suffix in fitted:
        if further:
            before = len(out.features)
            # unique against the table's columns outside the schema too
            further_ = [c for c in [*df.columns, *new] if c not in out.names]
            fresh = unique_names([*out.names, *further_, *(f"{c}_{suffix}" for c in columns)])[before + len(further_) :]
            out = Schema((*out.features, *((c, NUMERICAL) for c in fresh)))
            names = out.names[before:]
        else:
            names = columns
            places = [out.names.index(c) for c in columns]
            out = out.merged(places, Schema(tuple((c, NUMERICAL) for c in columns)))
        new |= {n: f.apply(c) for n, c in zip(names, columns, strict=True)}
        ancestors |= dict(zip(names, columns, strict=True))
    return df.withColumns(new), out, ancestors


@dataclass
class ModalPipeline:
    """Steps (name, modalities, fit): fit(df, columns) gives a Fitted for the columns of these modalities. fit_transform fits one after the other, transform applies them to other rows. Columns keep their places."""

    steps: Sequence[tuple[str, tuple[str, ...], Callable[[DataFrame, list[str]], t.Fitted]]]
    fitted: list[t.Fitted] = field(default_factory=list)

    def fit_transform(self, df: DataFrame, schema: Schema) -> DataFrame:
        self.fitted = []
        for _, modalities, fit in self.steps:
            if columns := schema.of(*modalities):
                self.fitted.append(fit(df, columns))
                df = self.fitted[-1].transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for f in self.fitted:
            df = f.transform(df)
        return df


def without_nulls(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Rows without a null (any), or with a value in some column (all); NaN counts as null."""
    kinds = dict(df.dtypes)
    known = [(F.col(c).isNotNull() & ~F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNotNull() for c in columns]
    if how not in ("any", "all"):
        raise ValueError(f"how must be any or all, got {how!r}")
    test = F.lit(how == "any")
    for k in known:
        test = test & k if how == "any" else test | k
    return df.where(test)


def legacy_categories(profile: DataFrame, provided: Sequence[str], min_rows: int = 100, max_category: int = 30, min_numeric: int = 4) -> DataFrame:
    """column of a profile's categories: provided ones of at most max_category values, and others of less than min_numeric in tables of more than min_rows rows."""
    known = F.col("column").isin(*provided) if provided else F.lit(False)
    return profile.where(F.when(known, F.col("distinct") <= max_category).otherwise((F.col("n") > min_rows) & (F.col("distinct") < min_numeric))).select("column")


def integer_categories(profile: DataFrame, max_category: int = 10) -> DataFrame:
    """column of a profile's columns of whole numbers with at most max_category values."""
    values = F.col("distinct") - (F.col("nulls") > 0).cast("int")
    return profile.where(F.col("whole") & (values <= max_category)).select("column")


def padded(values: Column | str, width: int, scale: bool = False) -> Column:
    """An array filled up with zeros to width, over its share of width on request."""
    v = F.col(values) if isinstance(values, str) else values
    share = F.size(v) / F.lit(float(width)) if scale else F.lit(1.0)
    return F.concat(F.transform(v, lambda x: x / share), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))


def nearest_point(x: Column, points: Sequence[Sequence[float]]) -> Column:
    """The place of the nearest of a few points to an array, the first of equals."""
    d = F.array(*(F.aggregate(F.zip_with(x, F.array(*map(F.lit, p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for p in points))
    return F.array_position(d, F.array_min(d)).cast("int") - 1
