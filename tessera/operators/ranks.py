"""Places, running sums and quantiles over a whole table, dealt out by ranges of a number.

Borders of the ranges are approximate quantiles, so a few numbers; a row's range is an
expression of its values. A value that holds several ranges is parted by the next column of
the order, so ties, flags and constants are dealt out too. What lies before a range is a sum a range, what lies before a row
within its range a window over the range. No task has more than a range, and equal values
are best counted together first.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most ranges; each row is compared with the borders.
RANGES = 256
#: Rows at most of a class that one task numbers.
ONE_TASK = 100_000
#: Rows at most of a table of classes and ranges that is sent to all tasks.
SENT = 100_000
INF, LARGEST = float("inf"), sys.float_info.max
NUMBER = re.compile("(tiny|small|big)?int$|float$|double$|decimal|boolean$")


def _place(column: str) -> Column:
    """A number in the column's order; nulls come before all others."""
    x = F.col(column).cast("double")
    return F.when(x.isNull(), -INF).when(x == -INF, F.lit(-LARGEST)).otherwise(x)


def ranged(df: DataFrame, order: list[str]) -> Column:
    """The number of a row's range, ascending with the order, whose first column is a number.

    Borders are quantiles of the first column. One that comes several times is a value of many rows: they are
    parted by as many quantiles of the next column, as long as that is a number.
    """
    n = max(2, min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = dict(df.dtypes)
    numeric = list(takewhile(lambda c: NUMBER.match(kinds[c]), order))
    borders: list[tuple[float, ...]] = []
    open_: list[tuple[tuple[float, ...], int]] = [((), n)]  # values of many rows, and the ranges for each
    for depth, column in enumerate(numeric):
        asked = []
        for i, (prefix, m) in enumerate(open_):
            same = F.lit(True)
            for c, v in zip(numeric, prefix):
                same = same & (_place(c) == F.lit(v))
            asked.append(F.percentile_approx(F.when(same, _place(column)), [k / m for k in range(1, m)], 20 * n).alias(f"q{i}"))  # within a 20th of a range
        found = df.agg(*asked).first()
        further = []
        for i, (prefix, _) in enumerate(open_):
            often = Counter(found[f"q{i}"] or [])
            borders += [(*prefix, v) for v in often]
            further += [((*prefix, v), k + 1) for v, k in often.items() if k > 1]
        if not further:
            break
        open_ = further
    if not borders:
        return F.lit(0)
    width = max(map(len, borders))
    tuples = sorted((*b, *[-INF] * (width - len(b))) for b in borders)
    if width == 1:
        own, sorted_borders = _place(numeric[0]), F.array(*(F.lit(t[0]) for t in tuples))
    else:
        own = F.struct(*(_place(c).alias(f"c{i}") for i, c in enumerate(numeric[:width])))
        sorted_borders = F.array(*(F.struct(*(F.lit(v).alias(f"c{i}") for i, v in enumerate(t))) for t in tuples))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(tuples).bit_length()))))
    # the borders that don't exceed the row, by halving; the row's place is made once
    halved = lambda x: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(sorted_borders, at + s - 1) <= x, at + s).otherwise(at))
    return F.get(F.transform(F.array(own), halved), F.lit(0))


def cumulated(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df with before_<s> for each of `sums`: its sum over all rows earlier in ascending `order`, whose first column is a number and whose columns make rows distinct."""
    rows = df.withColumn("__range", ranged(df, order))
    totals = {r["__range"]: r for r in rows.groupBy("__range").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums)).collect()}  # a row a range
    one = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.repartitionById(max(totals, default=0) + 1, F.col("__range"))  # a task a range; hashes would send several to one
    for s in sums:
        held, offsets = 0, []
        for k in range(max(totals, default=0) + 1):
            offsets.append(held)
            held += totals[k][s] if k in totals else 0
        out = out.withColumn(f"before_{s}", F.coalesce(F.sum(s).over(one), F.lit(0)) + F.get(F.array(*map(F.lit, offsets)), F.col("__range")))
    return out.drop("__range")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with each row's place from 1 in ascending `order` (see cumulated)."""
    out = cumulated(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"])
    return out.withColumn(into, F.col("before___one") + 1).drop("__one", "before___one")


def averaged(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with the rank of a number from 1, ascending, ties sharing their mean; nulls rank first."""
    counts = df.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = cumulated(counts, ["__value"], ["__n"]).select("__value", (F.col("before___n") + (F.col("__n") + 1) / 2).alias(into))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")


def quantiles(df: DataFrame, values: dict[str, Column], levels: list[float]) -> dict[str, list[float]]:
    """For each named number its exact quantiles, linear between neighbours; nulls are left out, and a column of nulls has none.

    Approximate quantiles a little below and above a level enclose its place. Values in between are
    counted one by one and those elsewhere together, so one scan finds the borders, and one for each column
    shuffles about a 2500th of the values a level. A place that isn't enclosed makes the next try wider.
    """
    names = list(values)
    rows = df.select(*(values[name].cast("double").alias(f"v{i}") for i, name in enumerate(names)))
    sides = lambda width: [x for p in levels for x in (max(0.0, p - width), min(1.0, p + width))]
    width = 2e-4
    first = rows.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))), *(F.percentile_approx(f"v{i}", sides(width), 10_000).alias(f"q{i}") for i in range(len(names)))).first()
    out = {}
    for i, name in enumerate(names):
        n, found = first[f"n{i}"], first[f"q{i}"]
        if not n:
            out[name] = []
            continue
        spots = [(n - 1) * p for p in levels]
        asked = sorted({int(s) for s in spots} | {int(-(-s // 1)) for s in spots})
        own, wide = rows.select(F.col(f"v{i}").alias("v")).where("v is not null"), width
        at = _at_places(own, list(zip(found[::2], found[1::2])), asked)
        while len(at) < len(asked):
            wide *= 10
            found = own.agg(F.percentile_approx("v", sides(wide), 10_000)).first()[0] if wide < 1 else [-INF, float("nan")]
            at = _at_places(own, list(zip(found[::2], found[1::2])), asked)
        picked = []
        for s in spots:
            low, high = int(s), int(-(-s // 1))
            picked.append(at[low] if low == high or at[low] == at[high] else (high - s) * at[low] + (s - low) * at[high])
        out[name] = picked
    return out


def _at_places(rows: DataFrame, brackets: list[tuple[float, float]], asked: list[int]) -> dict[int, float]:
    """The values v of rows at the places asked for, from 0 in ascending order, as far as they lie in the brackets."""
    apart: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if apart and low <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(high, apart[-1][1]))
        else:
            apart.append((low, high))
    segment = F.when(F.col("v") < F.lit(apart[0][0]), 0)
    for k, (low, high) in enumerate(apart):
        segment = segment.when(F.col("v") < F.lit(low), 2 * k).when(F.col("v") <= F.lit(high), 2 * k + 1)
    parted = rows.withColumn("segment", segment.otherwise(2 * len(apart)))
    counts = parted.groupBy("segment", F.when(F.col("segment") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")).persist()
    sizes = {r.segment: r.n for r in counts.groupBy("segment").agg(F.sum("n").alias("n")).collect()}  # two rows a level
    before = [sum(m for s, m in sizes.items() if s < k) for k in range(2 * len(apart) + 1)]
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("segment").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.get(F.array(*map(F.lit, before)), F.col("segment"))
    hit = F.filter(F.array(*(F.lit(a).cast("long") for a in asked)), lambda a: (a >= F.col("before")) & (a < F.col("before") + F.col("n")))
    placed = counts.where("segment % 2 = 1").withColumn("before", earlier).withColumn("hit", hit)
    at = {a: r.v for r in placed.where(F.size("hit") > 0).select("v", "hit").collect() for a in r.hit}  # two rows a level at most
    counts.unpersist()
    return at


def even_quantiles(df: DataFrame, value: Column, k: int) -> list[float]:
    """k exact quantiles of a number at equal distances from the least to the largest, linear between neighbours; none without values. Each distinct value gives the places it covers, so k may be thousands; 2 k rows are collected."""
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        return []
    if n == 1 or k == 1:
        return [counts.agg(F.min("v")).first()[0]] * k
    at, last = F.col("at"), n - 1
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("before_n") - 1) * (k - 1) / F.lit(last)) - 1), F.least(F.lit(k - 1), F.ceil((F.col("before_n") + F.col("n")) * (k - 1) / F.lit(last)) + 1))
    asked = cumulated(counts, ["v"], ["n"]).withColumn("at", F.explode(near.cast("array<bigint>")))
    place = F.expr(f"at * {last}L div {k - 1}L")
    asked = asked.withColumns({"low": place, "high": place + F.when(at * last % (k - 1) > 0, 1).otherwise(0)})
    covers = lambda c: (F.col(c) >= F.col("before_n")) & (F.col(c) < F.col("before_n") + F.col("n"))
    found = asked.groupBy("at").agg(F.max(F.when(covers("low"), F.col("v"))).alias("low"), F.max(F.when(covers("high"), F.col("v"))).alias("high"))
    rows = {r["at"]: r for r in found.collect()}
    return [rows[i].low if rows[i].low == rows[i].high else rows[i].low + (rows[i].high - rows[i].low) * (i * last % (k - 1)) / (k - 1) for i in range(k)]


def equal_mass_borders(df: DataFrame, value: Column, buckets: int) -> list[float]:
    """Borders between equally many of the sorted values: the least, middles between groups, the greatest. Values that don't fill a last group go; fewer values than buckets have none. A few places are picked from cumulated counts, so no values are collected."""
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    size = (counts.agg(F.sum("n")).first()[0] or 0) // buckets
    if not size:
        return []
    asked = sorted({0, size * buckets - 1} | {size * i + d for i in range(1, buckets) for d in (-1, 0)})
    hit = F.filter(F.array(*(F.lit(a).cast("long") for a in asked)), lambda a: (a >= F.col("before_n")) & (a < F.col("before_n") + F.col("n")))
    at = {a: r.v for r in cumulated(counts, ["v"], ["n"]).withColumn("hit", hit).where(F.size("hit") > 0).select("v", "hit").collect() for a in r.hit}
    return [at[0], *((at[size * i - 1] + at[size * i]) / 2 for i in range(1, buckets)), at[size * buckets - 1]]


def numbered_within(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """df with each row's place from 1 within its class, in ascending `order` (see cumulated). A class is dealt out by ranges too, so one that holds most rows isn't one task; where none has more than ONE_TASK rows, a window a class does. Null classes are a class."""
    most, classes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")).agg(F.max("__m"), F.count("__m")).first()
    if (most or 0) <= ONE_TASK:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    rows = df.withColumn("__range", ranged(df, order))
    sizes = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__m"))  # a row a class and range
    earlier = F.coalesce(F.sum("__m").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__range").alias("__range2"), earlier.alias("__before"))
    before = F.broadcast(before) if classes * 2 * RANGES <= SENT else before
    same = F.col("__range") == F.col("__range2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    return placed.join(before, same).withColumn(into, F.col("__before") + F.col("__place")).select(*df.columns, into)
