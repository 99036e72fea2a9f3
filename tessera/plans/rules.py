"""Queries of the constraint language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constraints import AnyOf, Const, Count, Feature, FeatureInfo, Log, Rules, SafeDivision, budgeted_repair, compiled, equality_fixes, guarded_fix, type_repair
from tessera.sources.tables import table

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
Q, P, D, T, N = (Feature(n) for n in NAMES)
KEYS = ["l_orderkey", "l_linenumber"]
RELATIONS = (
    D <= 1,
    T < D + 1,
    P.equals(Q * (P / Q), 1e-6),
    (Q <= 25) | (P >= 20000),
    Count((D <= 0.05, T <= 0.04, Q <= 30)) >= 2,
)
RULES = Rules((FeatureInfo("l_quantity", "int", True, 1, 50), FeatureInfo("l_extendedprice", "real", True, 0, 1e5), FeatureInfo("l_discount", "real", True, 0, 0.1), FeatureInfo("l_tax", "real", False, 0, 0.08), FeatureInfo("l_linenumber", "int", False, 1, 7)), RELATIONS, 0.5)
_VIOLATION = """(greatest(0, l_discount - 1) + greatest(0, l_tax - (l_discount + 1) + 2e-6)
 + greatest(0, abs(l_extendedprice - l_quantity * (l_extendedprice / l_quantity)) - 1e-6)
 + least(greatest(0, l_quantity - 25), greatest(0, 20000 - l_extendedprice))
 + greatest(0, 2 - ((l_discount <= 0.05)::INT + (l_tax <= 0.04)::INT + (l_quantity <= 30)::INT)))"""
_BOUNDS = "(l_quantity between 1 - 1.1920929e-07 and 50 + 1.1920929e-07 and l_extendedprice between 0 - 1.1920929e-07 and 1e5 + 1.1920929e-07 and l_discount between 0 - 1.1920929e-07 and 0.1 + 1.1920929e-07 and l_tax between 0 - 1.1920929e-07 and 0.08 + 1.1920929e-07 and l_linenumber between 1 and 7)"


def constraint_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", RULES.violation().alias("v"), RULES.valid().alias("ok"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("valid_share"), F.round(F.avg("v"), 4).alias("mean_violation"))


def constraint_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.round(RULES.violation(), 4).alias("violation")).where("violation > 0.5")


def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RULES.filter(table(spark, sf_dir, "lineitem")).select(*KEYS, "l_quantity")


def constraint_count_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = Count((D <= 0.05, T <= 0.04, Q <= 30), inverse=True)
    return table(spark, sf_dir, "lineitem").select(compiled(node, NAMES).cast("int").alias("violated")).groupBy("violated").agg(F.count(F.lit(1)).alias("n_rows"))


def constraint_safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = SafeDivision(T, D, Const(-1))
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.round(compiled(node, NAMES), 6).alias("ratio"))


def constraint_ieee_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = T / D
    return table(spark, sf_dir, "lineitem").select(compiled(node, NAMES).alias("x")).agg(F.count_if(F.col("x") == float("inf")).alias("n_infinite"), F.count_if(F.isnan("x")).alias("n_nan"))


def constraint_floor_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = (N - Const(4)) % Const(3)
    return table(spark, sf_dir, "lineitem").select(compiled(node, NAMES).cast("int").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n_rows"))


def constraint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = Log(D, Const(-10)) ** Const(2)
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.round(compiled(node, NAMES), 6).alias("x"))


def constraint_bounds_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_returnflag", RULES.bounds_hold().alias("b"), RULES.types_hold().alias("t")).groupBy("l_returnflag").agg(F.count_if("b").alias("in_bounds"), F.count_if("t").alias("typed"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with original columns o_ and moved features."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), *(F.col(n).cast("double").alias(f"o_{n}") for n in NAMES))
    return rows.select("l_orderkey", "k", *(f"o_{n}" for n in NAMES), (F.col("o_l_quantity") * 1.3 - 2).alias("l_quantity"), (F.col("o_l_extendedprice") * 0.9).alias("l_extendedprice"), (F.col("o_l_discount") + 0.013).alias("l_discount"), (F.col("o_l_tax") + 0.5).alias("l_tax"), (F.col("o_l_linenumber") + 0.7).alias("l_linenumber"))


def constraint_mutability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).withColumn("l_tax", F.when(F.col("k") % 2 == 0, F.col("o_l_tax")).otherwise(F.col("l_tax"))).withColumn("l_linenumber", F.col("o_l_linenumber"))
    return rows.groupBy("k").agg(F.count_if(RULES.unchanged("o_")).alias("unchanged"))


def constraint_guarded_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = guarded_fix(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), *NAMES), [(P.equals(Q + D), P, Q + D), (D <= 0.05, D, Const(0.05))], NAMES)
    return fixed.select("l_orderkey", "k", F.round("l_extendedprice", 6).alias("price"), F.round("l_discount", 6).alias("discount"))


def equality_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = guarded_fix(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), *NAMES), equality_fixes([T.equals(D * 2), D <= 1, P.equals(T * Q)]), NAMES)
    return fixed.select("l_orderkey", "k", F.round("l_tax", 6).alias("tax"), F.round("l_extendedprice", 6).alias("price"))


def type_immutable_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = type_repair(RULES, "o_")
    return _changed(spark, sf_dir).select("l_orderkey", "k", *(F.round(c, 6).alias(n) for n, c in fixed.items()))


def budget_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = budgeted_repair(RULES, "o_", {"l_quantity": 50.0, "l_extendedprice": 1e5, "l_discount": 0.1}, 0.1)
    return _changed(spark, sf_dir).select("l_orderkey", "k", *(F.round(fixed[n], 5).alias(n) for n in ("l_quantity", "l_extendedprice", "l_discount")))


def constraint_attack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one class whose predicted class is right and whose relations hold nearly exactly."""
    exact = Rules(RULES.features, RELATIONS, 1e-9)
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").where((F.col("l_discount") > 0.05) == (F.col("l_quantity") > 25))
    return rows.where(exact.relations_hold()).select(*KEYS)


QUERIES = {f.__name__: f for f in (constraint_success_rate, constraint_violation_rows, constraint_filter, constraint_count_inverse, constraint_safe_division, constraint_ieee_division, constraint_floor_mod, constraint_log, constraint_bounds_types, constraint_mutability, constraint_guarded_fix, equality_repair, type_immutable_repair, budget_repair, constraint_attack_filter)}
_MOVED = "SELECT l_orderkey, l_linenumber AS k, l_quantity q, l_extendedprice p, l_discount d, l_tax t, l_linenumber::DOUBLE n, l_quantity * 1.3 - 2 q1, l_extendedprice * 0.9 p1, l_discount + 0.013 d1 FROM lineitem"
ORACLES = {
    "constraint_success_rate": f"SELECT l_returnflag, count(*) AS n_rows, round(avg(({_VIOLATION} <= 0.5 AND {_BOUNDS} AND l_quantity = round_even(l_quantity, 0))::INT), 6) AS valid_share, round(avg({_VIOLATION}), 4) AS mean_violation FROM lineitem GROUP BY 1",
    "constraint_violation_rows": f"SELECT l_orderkey, l_linenumber, round({_VIOLATION}, 4) AS violation FROM lineitem WHERE round({_VIOLATION}, 4) > 0.5",
    "constraint_filter": f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_VIOLATION} <= 0.5",
    "constraint_count_inverse": "SELECT ((l_discount > 0.05)::INT + (l_tax > 0.04)::INT + (l_quantity > 30)::INT)::INT AS violated, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "constraint_safe_division": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE -1 END, 6) AS ratio FROM lineitem",
    "constraint_ieee_division": "SELECT count(*) FILTER (l_discount = 0 AND l_tax > 0) AS n_infinite, count(*) FILTER (l_discount = 0 AND l_tax = 0) AS n_nan FROM lineitem",
    "constraint_floor_mod": "SELECT (l_linenumber - 4 - 3 * floor((l_linenumber - 4) / 3.0))::INT AS m, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "constraint_log": "SELECT l_orderkey, l_linenumber, round(pow(CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE -10 END, 2), 6) AS x FROM lineitem",
    "constraint_bounds_types": f"SELECT l_returnflag, count(*) FILTER ({_BOUNDS}) AS in_bounds, count(*) FILTER (l_quantity = round_even(l_quantity, 0)) AS typed FROM lineitem GROUP BY 1",
    "constraint_mutability": "SELECT l_linenumber AS k, count(*) FILTER (l_linenumber % 2 = 0) AS unchanged FROM lineitem GROUP BY 1",
    "constraint_guarded_fix": "SELECT l_orderkey, l_linenumber AS k, round(CASE WHEN abs(l_extendedprice - (l_quantity + l_discount)) > 0 THEN l_quantity + l_discount ELSE l_extendedprice END, 6) AS price, round(CASE WHEN l_discount - 0.05 > 0 THEN 0.05 ELSE l_discount END, 6) AS discount FROM lineitem",
    "equality_repair": "SELECT l_orderkey, l_linenumber AS k, round(l_discount * 2, 6) AS tax, round(l_discount * 2 * l_quantity, 6) AS price FROM lineitem",
    "type_immutable_repair": f"SELECT l_orderkey, k, round(q + sign(q1 - q) * floor(abs(q1 - q)), 6) AS l_quantity, round(p1, 6) AS l_extendedprice, round(d1, 6) AS l_discount, t AS l_tax, n AS l_linenumber FROM ({_MOVED})",
    "budget_repair": f"""WITH m AS ({_MOVED}), s AS (SELECT *, q1 - q AS a, p1 - p AS b, d1 - d AS c, sqrt(pow((q1 - q) / 50.0, 2) + pow((p1 - p) / 1e5, 2) + pow((d1 - d) / 0.1, 2)) AS len FROM m),
f AS (SELECT *, CASE WHEN len > 0.1 THEN 0.1 / len ELSE 1.0 END AS first FROM s),
r AS (SELECT *, unnest(range(6)) AS i FROM f),
t AS (SELECT *, sign(a) * floor(abs(a * first * pow(0.9, i))) AS qa, b * first * pow(0.9, i) AS pa, c * first * pow(0.9, i) AS da FROM r),
g AS (SELECT *, sqrt(pow(qa / 50.0, 2) + pow(pa / 1e5, 2) + pow(da / 0.1, 2)) <= 0.1 + 1e-9 AS fits FROM t),
w AS (SELECT *, min(CASE WHEN fits THEN i END) OVER (PARTITION BY l_orderkey, k, q, p, d) AS best FROM g)
SELECT l_orderkey, k, round(q + CASE WHEN best IS NULL THEN 0 ELSE qa END, 5) AS l_quantity, round(p + CASE WHEN best IS NULL THEN 0 ELSE pa END, 5) AS l_extendedprice, round(d + CASE WHEN best IS NULL THEN 0 ELSE da END, 5) AS l_discount
FROM w WHERE i = coalesce(best, 0)""",
    "constraint_attack_filter": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_discount > 0.05) = (l_quantity > 25) AND {_VIOLATION} <= 1e-9",
}
