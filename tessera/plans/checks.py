"""Queries of guards, coercion, constants within batches and equal-mass borders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.operators import assessment as a
from tessera.operators import profile as pr
from tessera.operators import ranks
from tessera.operators import schema as sc
from tessera.operators import synthetic as sy
from tessera.sources.tables import table


def _passes(guard: Callable, *args) -> bool:
    try:
        guard(*args)
    except ValueError:
        return False
    return True


def guard_results(spark, sf_dir):
    """Which guards hold over the tables: sizes, labels, the same classes in two parts, and columns that keep the value they have in a part."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    found = {
        "size": _passes(pr.guard_size, lines, 10**9, 100),
        "few_rows": _passes(pr.guard_size, lines, 1000, 100),
        "toxic_labels": _passes(pr.guard_labels, table(spark, sf_dir, "labels"), "toxic", 2),
        "nine_classes": _passes(pr.guard_labels, table(spark, sf_dir, "embeddings"), "label", 9),
        "same_classes": sy.valid_split(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "o_orderpriority"),
        "exact_chunks": not pr.unseen_in_context(lines.where("l_returnflag = 'A'"), lines, ["l_returnflag", "l_quantity"]),
    }
    return spark.createDataFrame(sorted(found.items()), "guard string, holds boolean")


def least_category(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(c, a.least_common(o, c)) for c in ("o_orderpriority", "o_orderstatus")], "name string, n long")


def coerced_columns(spark, sf_dir):
    """Booleans and numbers as doubles, the rest as text, by sums and lengths."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("high"), F.col("value").cast("float").alias("value"), F.to_date("ts").alias("day"))
    out = sc.coerced(e)
    assert [k for _, k in out.dtypes] == ["double", "double", "double", "string"]
    return out.groupBy("day").agg(F.sum("event_id").alias("ids"), F.sum("high").alias("high"), F.round(F.sum("value"), 2).alias("value"))


def varying_entries(spark, sf_dir):
    """Eight entries of each embedding, of which the first `label` are constant within their label, without those and padded."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda v, i: F.when(i >= F.col("label"), v.cast("double")).otherwise(1.0)).alias("x"))
    out = sc.without_constants(e, "label", "x", 8)
    return out.select("vec_id", "n_features", *(F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(8)))


def equal_mass(spark, sf_dir):
    borders = ranks.equal_mass_borders(table(spark, sf_dir, "events"), F.col("value"), 8)
    return spark.createDataFrame([(i, round(b, 7)) for i, b in enumerate(borders)], "place int, border double")


QUERIES = {f.__name__: f for f in (guard_results, least_category, coerced_columns, varying_entries, equal_mass)}
ORACLES = {
    "guard_results": """
SELECT 'size' AS guard, count(*) <= 1000000000 AS holds FROM lineitem UNION ALL
SELECT 'few_rows', count(*) <= 1000 FROM lineitem UNION ALL
SELECT 'toxic_labels', list_sort(list(DISTINCT toxic)) = [0, 1] FROM labels UNION ALL
SELECT 'nine_classes', list_sort(list(DISTINCT label)) = range(9) FROM embeddings UNION ALL
SELECT 'same_classes', list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 0)) = list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 1)) FROM orders UNION ALL
SELECT 'exact_chunks', bool_and(l_returnflag = 'A') FROM lineitem
""",
    "least_category": "SELECT 'o_orderpriority' AS name, min(n) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) UNION ALL SELECT 'o_orderstatus', min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)",
    "coerced_columns": "SELECT (ts::DATE)::VARCHAR AS day, sum(event_id)::DOUBLE AS ids, sum((value > 50)::INT)::DOUBLE AS high, round(sum(value::FLOAT::DOUBLE), 2) AS value FROM events GROUP BY 1",
    "varying_entries": "SELECT vec_id, greatest(0, 8 - label)::INT AS n_features, " + ", ".join(f"round(CASE WHEN {i} + label < 8 THEN embedding[{i} + label + 1]::DOUBLE ELSE 0 END, 6) AS x{i}" for i in range(8)) + " FROM embeddings",
    "equal_mass": """
SELECT i::INT AS place, round(CASE WHEN i = 0 THEN v[1] WHEN i = 8 THEN v[s * 8] ELSE (v[s * i] + v[s * i + 1]) / 2 END, 7) AS border
FROM (SELECT list_sort(list(value)) AS v, count(value) // 8 AS s FROM events), (SELECT unnest(range(9)) AS i)
""",
}
