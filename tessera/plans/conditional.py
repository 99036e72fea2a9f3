"""Queries of chained conditionals over lines: price and quantity with nulls, given the discount."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import conditional as cd
from tessera.sources.tables import table

COLUMNS = ["price", "quantity", "discount"]


def _lines(spark, sf_dir):
    """id and three columns; quantity lacks a seventh, price a fifth of its values."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.select(key.alias("id"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice") / 1000).alias("price"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("double")).alias("quantity"), F.col("l_discount").cast("double").alias("discount"))


def impute_conditional(spark, sf_dir):
    """Quantity given price and discount, then price given the filled quantity and discount."""
    out = cd.imputed(_lines(spark, sf_dir), COLUMNS)
    return out.select("id", F.round("price", 5).alias("price"), F.round("quantity", 5).alias("quantity"))


def density_conditional(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("id", F.round(cd.log_density(cd.chain(rows, COLUMNS)), 6).alias("score"))


def synthesis_conditional(spark, sf_dir):
    """A drawn row for every line; a test compares moments, as SQL has no normal quantile."""
    rows = _lines(spark, sf_dir)
    out = cd.synthesised(rows, cd.chain(rows, COLUMNS), "id", seed=3)
    return out.select("id", *(F.round(c, 6).alias(c) for c in COLUMNS))


QUERIES = {f.__name__: f for f in (impute_conditional, density_conditional, synthesis_conditional)}

_ROWS = "(SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice / 1000 END AS p, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity::DOUBLE END AS q, l_discount::DOUBLE AS d FROM lineitem)"


def _two(y, a, b):
    """Weights of a and b and the intercept of a regression of y, over rows that have y."""
    v = {"aa": f"var_pop({a})", "bb": f"var_pop({b})", "ab": f"covar_pop({a}, {b})", "ay": f"covar_pop({a}, {y})", "by": f"covar_pop({b}, {y})"}
    w = f"(({v['ay']} * {v['bb']} - {v['by']} * {v['ab']}) / ({v['aa']} * {v['bb']} - {v['ab']} * {v['ab']}))", f"(({v['by']} * {v['aa']} - {v['ay']} * {v['ab']}) / ({v['aa']} * {v['bb']} - {v['ab']} * {v['ab']}))"
    return f"{w[0]} AS w, {w[1]} AS u, avg({y}) - {w[0]} * avg({a}) - {w[1]} * avg({b}) AS c, sqrt(var_pop({y}) - {w[0]} * {v['ay']} - {w[1]} * {v['by']}) AS s"


_HALF = 0.5 * math.log(2 * math.pi)
ORACLES = {
    "impute_conditional": f"""
WITH started AS (
  SELECT *, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM {_ROWS})) AS p0 FROM {_ROWS}
), first AS (
  SELECT {_two("q", "p0", "d")} FROM started WHERE q IS NOT NULL
), filled AS (
  SELECT id, p, d, coalesce(q, c + w * p0 + u * d) AS q1 FROM started, first
), second AS (
  SELECT {_two("p", "q1", "d")} FROM filled WHERE p IS NOT NULL
)
SELECT id, round(coalesce(p, c + w * q1 + u * d), 5) AS price, round(q1, 5) AS quantity FROM filled, second
""",
    "density_conditional": f"""
WITH known AS (
  SELECT * FROM {_ROWS} WHERE p IS NOT NULL AND q IS NOT NULL AND d IS NOT NULL
), one AS (
  SELECT avg(p) AS m, stddev_pop(p) AS s FROM known
), two AS (
  SELECT regr_slope(q, p) AS w, regr_intercept(q, p) AS c, sqrt(var_pop(q) - regr_slope(q, p) * covar_pop(p, q)) AS s FROM known
), three AS (
  SELECT {_two("d", "p", "q")} FROM known
)
SELECT id, round(-pow((p - one.m) / one.s, 2) / 2 - ln(one.s) - pow((q - two.c - two.w * p) / two.s, 2) / 2 - ln(two.s) - pow((d - three.c - three.w * p - three.u * q) / three.s, 2) / 2 - ln(three.s) - {3 * _HALF!r}, 6) AS score
FROM {_ROWS}, one, two, three
""",
}
