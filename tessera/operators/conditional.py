"""Chained conditional models of numeric columns: imputation in order of missingness, density as a sum of conditional log-likelihoods, and synthesis.

A conditional is a linear model with Gaussian residuals. Its fit is one aggregate of means and
covariances, solved on the driver as a small matrix; its use is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.confident import let
from tessera.operators.loops import cut
from tessera.operators.ranks import quantiles
from tessera.operators.schema import unique_names
from tessera.operators.tails import chance, keyed_normal, probit

#: The least deviation of residuals, so that densities of exact relations stay finite.
LEAST = 1e-9


@dataclass(frozen=True)
class Linear:
    """intercept + weights . features, with the deviation of what is left."""

    target: str
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    deviation: float

    def mean(self, of: dict[str, Column] | None = None) -> Column:
        """The conditional mean; `of` gives columns for the features, else their names do."""
        out = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights):
            out = out + F.lit(w) * (of[f] if of else F.col(f))
        return out


def _solved(target: str, features: Sequence[str], mean: dict[str, float], cov: dict[tuple[str, str], float]) -> Linear:
    c = lambda a, b: cov[(a, b) if (a, b) in cov else (b, a)]
    if features:
        # least squares, so that a constant or repeated feature has no weight of its own
        w = np.linalg.lstsq(np.array([[c(a, b) for b in features] for a in features]), np.array([c(a, target) for a in features]), rcond=1e-12)[0]
    else:
        w = np.zeros(0)
    left = c(target, target) - float(sum(x * c(a, target) for x, a in zip(w, features)))
    return Linear(target, tuple(features), tuple(map(float, w)), mean[target] - float(sum(x * mean[a] for x, a in zip(w, features))), max(math.sqrt(max(left, 0.0)), LEAST))


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[dict, dict]:
    """Means and covariances over rows without nulls in the columns, in one aggregate."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x = {c: F.when(known, F.col(c).cast("double")) for c in columns}
    row = df.agg(*(F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    return {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}, {p: row[f"c{i}"] or 0.0 for i, p in enumerate(pairs)}


def fit_linear(df: DataFrame, target: str, features: Sequence[str]) -> Linear:
    """The conditional of target given features, over rows that have all of them."""
    return _solved(target, features, *_moments(df, [target, *features]))


def imputed(df: DataFrame, columns: Sequence[str], *, rounds: int = 1, temperature: float = 0.0, tolerance: float = 0.0, id_column: str | None = None, seed: int = 0) -> DataFrame:
    """df with the nulls of columns filled: from medians on, the column with fewest nulls first (equal ones in the given order), each by its conditional given all others, fitted to rows where it is known; as many rounds, or until no mean of the filled values moves by more than tolerance deviations.

    With a temperature a keyed normal times it and the residual deviation is added (id_column names the row).
    A column without a value is filled with 0. NaN counts as a value; make it null before.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"k{i}") for i, c in enumerate(columns))).first()
    missing = {c: row.n - row[f"k{i}"] for i, c in enumerate(columns)}
    order = [c for c in sorted(columns, key=lambda c: missing[c]) if missing[c]]
    if not order:
        return df
    medians = quantiles(df, {c: F.col(c) for c in order}, [0.5])
    spare = unique_names([*df.columns, *(f"__was_{c}" for c in order)])[len(df.columns) :]
    was = dict(zip(order, spare))
    state = df.withColumns({was[c]: F.col(c) for c in order}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0] if medians[c] else 0.0)) for c in order})
    before = None
    for k in range(rounds):
        models = []
        for c in order:
            others = [o for o in columns if o != c]
            # learned from rows where the column was known
            known = state.select(*others, F.col(was[c]).cast("double").alias(c))
            model = fit_linear(known, c, others)
            models.append(model)
            guess = model.mean()
            if temperature:
                guess = guess + F.lit(temperature * model.deviation) * keyed_normal(seed, f"impute|{k}|{c}", id_column)
            state = state.withColumn(c, F.coalesce(F.col(was[c]).cast("double"), guess))
        state = cut(state)
        if tolerance:
            means = state.agg(*(F.avg(F.when(F.col(was[c]).isNull(), F.col(c))).alias(c) for c in order)).first()
            if before is not None and all(abs((means[c] or 0.0) - (before[c] or 0.0)) <= tolerance * m.deviation for c, m in zip(order, models)):
                break
            before = means
    return state.select(*df.columns)


def chain(df: DataFrame, columns: Sequence[str]) -> list[Linear]:
    """The conditional of each column given those before it, all from one aggregate over rows without nulls."""
    mean, cov = _moments(df, columns)
    return [_solved(c, columns[:i], mean, cov) for i, c in enumerate(columns)]


def log_density(models: Sequence[Linear]) -> Column:
    """The sum of conditional log-likelihoods of a row; null where a column is."""
    out = F.lit(0.0)
    for m in models:
        out = out - F.pow((F.col(m.target) - m.mean()) / F.lit(m.deviation), 2) / 2 - F.lit(math.log(m.deviation) + 0.5 * math.log(2 * math.pi))
    return out


def synthesised(rows: DataFrame, models: Sequence[Linear], id_column: str, *, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """id_column and a drawn value of each model's column for every row, one after the other along the chain."""
    # chances are columns of their own, so that each is made once a row
    chances = unique_names([id_column, *(m.target for m in models), *(f"__p_{m.target}" for m in models)])[len(models) + 1 :]
    out = rows.select(id_column).withColumns({p: chance(seed, f"draw|{m.target}", id_column) for p, m in zip(chances, models)})
    for p, m in zip(chances, models):
        out = out.withColumn(m.target, m.mean() + F.lit(temperature * m.deviation) * let(F.col(p), probit))
    return out.drop(*chances)
