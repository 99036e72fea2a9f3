"""Profiles of tables: modality of columns, signs and types, censuses, and checks of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column from one aggregate: column, n, nulls, distinct (a null counts as a value), numbers and dates among texts, whole, low, high."""
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(columns):
        text = kinds[c] == "string"
        x = F.col(c)
        as_number = F.when(x.rlike(NUMBER), x.cast("double")) if text else x.cast("double") if not kinds[c].startswith(("timestamp", "date", "boolean")) else F.lit(None).cast("double")
        parts += [
            F.count(x).alias(f"k{i}"),
            (F.count_distinct(x) + F.when(F.count(x) < F.count(F.lit(1)), 1).otherwise(0)).alias(f"u{i}"),
            F.count(as_number).alias(f"m{i}"),
            (F.count(F.try_to_timestamp(x)) if text else F.count(x) if kinds[c].startswith(("timestamp", "date")) else F.lit(0)).alias(f"d{i}"),
            F.coalesce(F.bool_and(as_number == F.floor(as_number)), F.lit(False)).alias(f"w{i}"),
            F.min(as_number).alias(f"a{i}"),
            F.max(as_number).alias(f"b{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c] == "string").alias("text"), "n", (F.col("n") - F.col(f"k{i}")).alias("nulls"), F.col(f"u{i}").alias("distinct"), F.col(f"m{i}").alias("numbers"), F.col(f"d{i}").cast("long").alias("dates"), F.col(f"w{i}").alias("whole"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def modality(p: DataFrame, declared: list[str] | None = None, min_rows: int = 100, max_category: int = 30, min_numeric: int = 4, min_text: int = 30) -> DataFrame:
    """column, modality: constant, numerical, categorical, date or text.

    Declared categories are such up to max_category values. A numeric column of less than min_numeric
    values in more than min_rows rows is categorical, as is a text of less than min_text values.
    """
    known = F.col("column").isin(declared or [])
    filled = F.col("n") - F.col("nulls")
    numeric = (F.col("numbers") == filled) & (filled > 0)
    rule = (
        F.when((F.col("distinct") <= 1) & ~known, "constant")
        .when(known & (F.col("distinct") <= max_category), "categorical")
        .when(numeric & ~known & (F.col("n") > min_rows) & (F.col("distinct") < min_numeric), "categorical")
        .when(numeric, "numerical")
        .when((F.col("dates") == filled) & (filled > 0), "date")
        .when(F.col("distinct") < min_text, "categorical")
        .otherwise("text")
    )
    return p.select("column", rule.alias("modality"))


def type_tag(p: DataFrame) -> DataFrame:
    """column, tag: cat for texts, int for whole numbers, else real."""
    return p.select("column", F.when(F.col("text"), "cat").when(F.col("whole"), "int").otherwise("real").alias("tag"))


def sign_class(p: DataFrame) -> DataFrame:
    return p.select("column", F.when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").when(F.col("low") >= 0, "non-negative").when(F.col("high") <= 0, "non-positive").otherwise("mixed").alias("sign"))


def sentinel_census(df: DataFrame, columns: list[str], sentinels: list[float]) -> DataFrame:
    """sentinel, cells and columns with it: one aggregate, a counter a column and sentinel."""
    row = df.agg(*(F.count_if(F.col(c).cast("double") == F.lit(float(s))).alias(f"c{i}_{j}") for i, s in enumerate(sentinels) for j, c in enumerate(columns)))
    total = lambda i: sum((F.col(f"c{i}_{j}") for j in range(1, len(columns))), F.col(f"c{i}_0"))
    some = lambda i: sum(((F.col(f"c{i}_{j}") > 0).cast("int") for j in range(1, len(columns))), (F.col(f"c{i}_0") > 0).cast("int"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(s)).alias("sentinel"), total(i).alias("cells"), some(i).alias("columns")) for i, s in enumerate(sentinels)))).alias("x")).select("x.*")


def violated(holds: Column) -> Column:
    """Rows that a relation doesn't hold for; an unknown comparison counts as one."""
    return F.count_if(~F.coalesce(holds, F.lit(False)))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, share, and the ratio of the largest to the smallest class with its grade."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))  # a row a class
    ratio = F.max("n").over(one) / F.min("n").over(one)
    return counts.select(label, "n", (F.col("n") / F.sum("n").over(one)).alias("share"), ratio.alias("ratio"), F.when(ratio <= 2, "balanced").when(ratio <= 4, "moderate").otherwise("imbalanced").alias("grade"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"))


def unseen_in_context(context: DataFrame, test: DataFrame, columns: list[str]) -> list[str]:
    """Columns constant in context that don't keep that value in test."""
    a = context.agg(*(F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in columns)).first()
    fixed = [c for c in columns if a[c] is not None]
    if not fixed:
        return []
    b = test.agg(*(F.coalesce(F.bool_and(F.col(c) == F.lit(a[c])), F.lit(True)).alias(c) for c in fixed)).first()
    return [c for c in fixed if not b[c]]


def guard_size(df: DataFrame, rows: int, columns: int) -> None:
    """Raises for tables beyond the limits."""
    if len(df.columns) > columns or df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows or {columns} columns")


def guard_labels(df: DataFrame, label: str, classes: int) -> None:
    """Raises unless labels are the classes 0 to classes - 1, each present."""
    found = {r[0] for r in df.select(label).distinct().limit(classes + 1).collect()}
    if found != set(range(classes)):
        raise ValueError(f"labels aren't the classes 0 to {classes - 1}")
