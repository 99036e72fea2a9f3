"""Operators on many keyed time series: one row per item and timestamp, further columns carried along."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Period of each calendar feature; weekday from Monday, all counted from zero.
SEASONS = {"second": 60.0, "minute": 60.0, "hour": 24.0, "weekday": 7.0, "day": 30.5, "dayofyear": 366.0, "week": 53.0, "month": 12.0}


class Series:
    """A frame with its key columns."""

    def __init__(self, df: DataFrame, item: str = "item_id", time: str = "timestamp", target: str = "target"):
        for c in (item, time):
            if c not in df.columns:
                raise ValueError(f"no column {c}")
        self.df, self.item, self.time, self.target = df, item, time, target

    @staticmethod
    def renamed(df: DataFrame, item: str, time: str) -> Series:
        """From any frame: its id and time columns become item_id and timestamp; other columns of those names get two underscores."""
        for new, old in (("item_id", item), ("timestamp", time)):
            if new in df.columns and new != old:
                df = df.withColumnRenamed(new, f"__{new}")
            df = df.withColumnRenamed(old, new)
        return Series(df)

    @staticmethod
    def exploded(df: DataFrame, start: str, step: str, values: str, item: str) -> Series:
        """From a row per series with a start and an array of values, a step apart (an interval's text)."""
        rows = df.select(F.col(item).alias("item_id"), F.col(start).alias("__start"), F.posexplode(values).alias("__k", "target"))
        return Series(rows.select("item_id", F.expr(f"__start + __k * INTERVAL {step}").alias("timestamp"), "target"))

    def with_df(self, df: DataFrame) -> Series:
        return Series(df, self.item, self.time, self.target)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(self.item).orderBy(self.time)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.item)

    def slice(self, start: int | None, stop: int | None) -> Series:
        """Rows start to stop of each item in time order, as Python slices count."""
        place, n = F.col("__place"), F.col("__n")
        bound = lambda b, none: none if b is None else F.greatest(n + b, F.lit(0)) if b < 0 else F.least(F.lit(b), n)
        rows = self.df.withColumn("__place", F.row_number().over(self.ordered()) - 1).withColumn("__n", F.count(F.lit(1)).over(self.whole()))
        return self.with_df(rows.where((place >= bound(start, F.lit(0))) & (place < bound(stop, n))).drop("__place", "__n"))

    def between(self, start: str | None, stop: str | None) -> Series:
        """Rows from start on and before stop."""
        df = self.df
        if start is not None:
            df = df.where(F.col(self.time) >= F.lit(start).cast("timestamp_ntz"))
        if stop is not None:
            df = df.where(F.col(self.time) < F.lit(stop).cast("timestamp_ntz"))
        return self.with_df(df)

    def split_at(self, cutoff: str) -> tuple[Series, Series]:
        return self.between(None, cutoff), self.between(cutoff, None)

    def train_test(self, horizon: int, suffix: str = "") -> tuple[Series, Series]:
        """All but the last `horizon` rows of each item, and whole items; identifiers get the suffix."""
        named = self.with_df(self.df.withColumn(self.item, F.concat(F.col(self.item).cast("string"), F.lit(suffix)))) if suffix else self
        return named.slice(None, -horizon), named

    def running_index(self) -> Column:
        return F.row_number().over(self.ordered()) - 1

    def filled(self, method: str = "auto", value: float | None = None, columns: list[str] | None = None) -> Series:
        """Nulls of columns (the target) from the last value before, the next one after, both in turn (auto), the line between both by place (interpolate: nulls before the first value stay), or a constant."""
        before = self.ordered().rowsBetween(Window.unboundedPreceding, 0)
        after = self.ordered().rowsBetween(0, Window.unboundedFollowing)
        df = self.df
        if method == "interpolate":
            df = df.withColumn("__place", F.row_number().over(self.ordered()))
        out = {}
        for c in columns or [self.target]:
            last, nxt = F.last(c, True).over(before), F.first(c, True).over(after)
            if method == "constant":
                out[c] = F.coalesce(c, F.lit(value))
            elif method == "interpolate":
                at = F.when(F.col(c).isNotNull(), F.col("__place"))
                a, b = F.last(at, True).over(before), F.first(at, True).over(after)
                out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), last).when(a.isNotNull(), last + (nxt - last) * (F.col("__place") - a) / (b - a))
            else:
                out[c] = {"auto": F.coalesce(last, nxt), "ffill": last, "bfill": nxt}[method]
        return self.with_df(df.withColumns(out).drop("__place"))

    def imputed_target(self) -> Series:
        """Null targets of series with at most one value become 0; other rows without a target go."""
        df = self.df.withColumn("__n", F.count(self.target).over(self.whole()))
        df = df.withColumn(self.target, F.when(F.col("__n") <= 1, F.coalesce(F.col(self.target), F.lit(0.0))).otherwise(F.col(self.target)))
        return self.with_df(df.drop("__n").where(F.col(self.target).isNotNull()))

    def steps(self) -> DataFrame:
        """Per item: rows, and the least and most seconds between rows that follow each other."""
        gap = F.unix_timestamp(F.col(self.time).cast("timestamp")) - F.unix_timestamp(F.lag(self.time).over(self.ordered()).cast("timestamp"))
        return self.df.withColumn("__gap", gap).groupBy(self.item).agg(F.count(F.lit(1)).alias("n"), F.min("__gap").alias("least"), F.max("__gap").alias("most"))

    def frequency(self) -> int | None:
        """The one step in seconds of all items with two rows or more; None if they differ or a step varies."""
        r = self.steps().where("n > 1").agg(F.min("least").alias("a"), F.max("most").alias("b")).first()
        return r.a if r.a is not None and r.a == r.b else None

    def resampled(self, unit: str, how: str = "mean") -> Series:
        """Every item on a grid of whole units (hour, day, week, month, quarter, year) from its first to its last: mean, sum, min, max, median, first or last of the target in each. Bins without values are null, 0 for sum."""
        own = F.col(self.target)
        agg = {"mean": F.avg(own), "sum": F.sum(own), "min": F.min(own), "max": F.max(own), "median": F.percentile(own, 0.5), "first": F.min_by(own, F.when(own.isNotNull(), F.col(self.time))), "last": F.max_by(own, F.when(own.isNotNull(), F.col(self.time)))}[how]
        bins = self.df.withColumn("__bin", F.date_trunc(unit, F.col(self.time)).cast("timestamp_ntz")).groupBy(self.item, "__bin").agg(agg.alias(self.target))
        step = F.expr(f"INTERVAL {3 if unit == 'quarter' else 1} {'month' if unit == 'quarter' else unit}")
        grid = bins.groupBy(self.item).agg(F.min("__bin").alias("a"), F.max("__bin").alias("b")).select(self.item, F.explode(F.sequence("a", "b", step)).alias("__bin"))
        rows = grid.join(bins, [self.item, "__bin"], "left").withColumnRenamed("__bin", self.time)
        return self.with_df(rows.fillna(0.0, [self.target]) if how == "sum" else rows)

    def horizon(self, length: int, step: str) -> DataFrame:
        """The next `length` timestamps of each item, with a null target."""
        last = self.df.groupBy(self.item).agg(F.max(self.time).alias("__last"))
        rows = last.select(self.item, "__last", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("__k"))
        return rows.select(self.item, F.expr(f"__last + __k * INTERVAL {step}").alias(self.time), F.lit(None).cast("double").alias(self.target))

    def calendar(self, features: list[str] | None = None) -> Series:
        """year, and the sine and cosine of each seasonal feature over its period."""
        t = F.col(self.time)
        part = {"second": F.second(t), "minute": F.minute(t), "hour": F.hour(t), "weekday": F.weekday(t), "day": F.dayofmonth(t) - 1, "dayofyear": F.dayofyear(t) - 1, "week": F.weekofyear(t) - 1, "month": F.month(t) - 1}
        out = {"year": F.year(t)}
        for name in features or list(SEASONS):
            angle = part[name] * F.lit(2.0) * F.pi() / F.lit(SEASONS[name])
            out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
        return self.with_df(self.df.withColumns(out))

    def fourier(self, periods: list[float]) -> Series:
        place = F.row_number().over(self.ordered()) - 1
        out = {}
        for i, p in enumerate(periods):
            angle = place * F.lit(2.0) * F.pi() / F.lit(float(p))
            out |= {f"sin_{i}": F.sin(angle), f"cos_{i}": F.cos(angle)}
        return self.with_df(self.df.withColumns(out))

    def first_difference(self) -> Column:
        return F.col(self.target) - F.coalesce(F.lag(self.target).over(self.ordered()), F.col(self.target))

    def detrended(self, kind: str = "linear") -> Series:
        """The target less its mean, or less its least-squares line over the place."""
        df = self.df.withColumn("__place", (F.row_number().over(self.ordered()) - 1).cast("double"))
        y, x = F.col(self.target), F.col("__place")
        if kind == "constant":
            fit = F.avg(y).over(self.whole())
        else:
            slope = F.regr_slope(y, x).over(self.whole())
            fit = F.coalesce(slope, F.lit(0.0)) * (x - F.avg(F.when(y.isNotNull(), x)).over(self.whole())) + F.avg(y).over(self.whole())
        return self.with_df(df.withColumn(self.target, y - fit).drop("__place"))

    def with_static(self, static: DataFrame) -> DataFrame:
        """Joined to one row per item of static; items that it lacks raise, items of its own go."""
        missing = self.df.select(self.item).distinct().join(static, self.item, "left_anti")
        if not missing.isEmpty():
            raise ValueError("items without static features")
        return self.df.join(static, self.item)

    def contains(self, other: Series) -> bool:
        """Whether each item and timestamp of other is here too."""
        return other.df.join(self.df, [self.item, self.time], "left_anti").isEmpty()


def concatenated(parts: list[Series]) -> Series:
    return parts[0].with_df(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.df for p in parts)))


def chained(context: Series, future: DataFrame, transforms: list) -> tuple[DataFrame, DataFrame]:
    """Transforms (Series -> Series) over context and future rows as one series, then split again."""
    both = context.df.withColumn("__future", F.lit(False)).unionByName(future.withColumn("__future", F.lit(True)), allowMissingColumns=True)
    out = context.with_df(both)
    for t in transforms:
        out = t(out)
    return out.df.where(~F.col("__future")).drop("__future"), out.df.where("__future").drop("__future", context.target)
