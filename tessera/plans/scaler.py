"""Queries of the mixed encoding over lines: numbers by metadata or fitted, line numbers and flags as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.scaler import MixedScaler
from tessera.sources.tables import table

METADATA = [
    {"feature": "l_quantity", "type": "int", "min": 1, "max": 50},
    {"feature": "l_linenumber", "type": "cat", "min": 1, "max": 7},
    {"feature": "l_discount", "type": "real", "min": 0, "max": 0.1},
    {"feature": "l_constant", "type": "real", "min": 3, "max": 3},
]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_constant", F.lit(3.0))


def mixed_encoding(spark, sf_dir):
    """The encoded entries of each line, numbers first."""
    s = MixedScaler.from_metadata(METADATA, low=-1.0, high=1.0)
    x = s.encoded()
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.round(F.get(x, F.lit(i)), 7).alias(f"x{i}") for i in range(s.size)))


def mixed_round_trip(spark, sf_dir):
    """Fitted on the lines, encoded and decoded again: what returns, with the flag from its block."""
    columns = ["l_quantity", "l_returnflag", "l_extendedprice", "l_linenumber"]
    lines = _lines(spark, sf_dir)
    s = MixedScaler.fit(lines, columns, ["l_returnflag", "l_linenumber"], "standard")
    coded = lines.select("l_orderkey", s.encoded().alias("x"))
    back = s.decoded(F.col("x"))
    return coded.select("l_orderkey", *((F.round(back[c], 4) if c in ("l_quantity", "l_extendedprice") else back[c]).alias(c) for c in columns))


QUERIES = {f.__name__: f for f in (mixed_encoding, mixed_round_trip)}
ORACLES = {
    "mixed_encoding": "SELECT l_orderkey, l_linenumber, round((l_quantity - 1) / 49.0 * 2 - 1, 7) AS x0, round(l_discount / 0.1 * 2 - 1, 7) AS x1, -1.0 AS x2, " + ", ".join(f"(l_linenumber = {i})::INT::DOUBLE AS x{i + 2}" for i in range(1, 8)) + " FROM lineitem",
    "mixed_round_trip": "SELECT l_orderkey, round(l_quantity::DOUBLE, 4) AS l_quantity, l_returnflag, round(l_extendedprice::DOUBLE, 4) AS l_extendedprice, l_linenumber FROM lineitem",
}
