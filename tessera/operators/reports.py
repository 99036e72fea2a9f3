"""Aggregates of experiment records: summaries, intervals, ranks, battles, bootstraps and ratings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranks import numbered

#: Fixed: two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, then of the normal distribution.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.13145, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.05183, 2.048407, 2.04523, 2.042272]
NORMAL_975 = 1.959964


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def stats(c: str) -> list[Column]:
    """mean, population deviation, min, max and number of the finite values."""
    x = finite(F.col(c).cast("double"))
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")]


def trial_summary(trials: DataFrame, run: str, part: str, metric: str) -> DataFrame:
    """Statistics over all trials, by run and by part in one pass of grouping sets, and of the runs' and parts' means: level, key, mean, std, low, high, n."""
    x = trials.select(F.col(run).cast("string").alias("run"), F.col(part).cast("string").alias("part"), F.col(metric).alias("m"))
    sets = x.groupingSets([[], ["run"], ["part"]], "run", "part").agg(F.grouping("run").alias("no_run"), F.grouping("part").alias("no_part"), *stats("m"))
    level = F.when((F.col("no_run") == 1) & (F.col("no_part") == 1), "overall").when(F.col("no_run") == 0, "by_run").otherwise("by_part")
    first = sets.select(level.alias("level"), F.coalesce("run", "part").alias("key"), "mean", "std", "low", "high", "n")
    second = first.where("level <> 'overall'").groupBy(F.concat(F.lit("across_"), F.expr("substr(level, 4)")).alias("level")).agg(*stats("mean"))
    return first.unionByName(second.withColumn("key", F.lit(None).cast("string")))


def best_per(df: DataFrame, run: str, metric: str, tie: str) -> DataFrame:
    """The row of each run with the largest metric, the smallest tie column of several."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(metric), tie))).where("__r = 1").drop("__r")


def t_quantile(n: Column) -> Column:
    return F.when(n - 1 <= len(T_975), F.element_at(F.array(*map(F.lit, T_975)), F.greatest(F.lit(1), n - 1).cast("int"))).otherwise(F.lit(NORMAL_975))


def t_interval(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Mean and half width of its 95 % interval; null for one value."""
    a = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("s"), F.count(c).alias("n"))
    return a.select(*by, "mean", F.when(F.col("n") > 1, t_quantile(F.col("n")) * F.col("s") / F.sqrt("n")).alias("half"), "n")


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def paired_difference(df: DataFrame, task: str, entry: str, value: str, baseline: str) -> DataFrame:
    """Per task and entry: the value less the baseline's in the same task."""
    base = df.where(F.col(entry) == baseline).select(task, F.col(value).alias("__base"))
    return df.where(F.col(entry) != baseline).join(base, task).select(task, entry, (F.col(value) - F.col("__base")).alias("difference"))


def battles(df: DataFrame, task: str, entry: str, error: str) -> DataFrame:
    """a, b (a before b in order), wins of a (ties half) and battles over tasks that have both.

    Entries are few; the join is within a task.
    """
    one = df.select(F.col(task).alias("t"), F.col(entry).alias("a"), F.col(error).alias("x"))
    two = df.select(F.col(task).alias("t"), F.col(entry).alias("b"), F.col(error).alias("y"))
    pair = one.join(two, "t").where("a < b")
    win = F.when(F.col("x") < F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)
    return pair.groupBy("a", "b").agg(F.sum(win).alias("wins"), F.count(F.lit(1)).alias("n"))


def win_rates(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("entry"), "wins", "n").unionByName(pairs.select(F.col("b").alias("entry"), (F.col("n") - F.col("wins")).alias("wins"), "n"))
    return both.groupBy("entry").agg((F.sum("wins") / F.sum("n")).alias("rate"))


def elo(pairs: DataFrame, anchor: str | None = None, rating: float = 1000.0, rounds: int = 500, prior: float = 0.0) -> dict:
    """Bradley-Terry ratings on the scale of 400 points to ten times the odds, the anchor (or the mean) at `rating`.

    Pairs are counted in Spark; the m by m problem is solved here by minorisation. prior: drawn battles added to each pair met;
    without any, an entry that won or lost all its battles has an infinite rating.
    """
    rows = pairs.collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    wins, games = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in rows:
        i, j = at[r.a], at[r.b]
        wins[i] += r.wins + prior / 2
        wins[j] += r.n - r.wins + prior / 2
        games[i, j] += r.n + prior
        games[j, i] += r.n + prior
    p = np.ones(len(names))
    for _ in range(rounds):
        p = wins / (games / (p[:, None] + p[None, :])).sum(1)
        p /= np.exp(np.log(p).mean())
    points = 400 * np.log10(p)
    base = points[at[anchor]] if anchor is not None else points.mean()
    return {n: float(points[at[n]] - base + rating) for n in names}


def mean_ranks(df: DataFrame, task: str, entry: str, value: str) -> DataFrame:
    """Mean over tasks of the rank by value, ties averaged."""
    one = Window.partitionBy(task)
    rank = F.rank().over(one.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(task, value)) - 1) / 2
    return df.withColumn("__r", rank).groupBy(entry).agg(F.avg("__r").alias("mean_rank"))


def regret(df: DataFrame, run: str, value: str) -> DataFrame:
    """df with regret: distance from the run's best value over the distance from best to worst; 0 where they are equal."""
    one = Window.partitionBy(run)
    best, worst = F.max(value).over(one), F.min(value).over(one)
    return df.withColumn("regret", F.when(best != worst, F.abs(best - F.col(value)) / F.abs(best - worst)).otherwise(0.0))


def improvability(df: DataFrame, task: str, entry: str, error: str) -> DataFrame:
    """Mean over tasks of 1 - best error / own error."""
    best = F.min(error).over(Window.partitionBy(task))
    return df.withColumn("__i", F.when(F.col(error) != 0, 1 - best / F.col(error)).otherwise(0.0)).groupBy(entry).agg(F.avg("__i").alias("improvability"))


def spearman(df: DataFrame, x: str, y: str, id_column: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of ranks by place, ties in order of the identifier."""
    keys = by or []
    one = Window.partitionBy(*(keys or [F.lit(0)]))
    return df.select(*keys, F.row_number().over(one.orderBy(x, id_column)).cast("double").alias("a"), F.row_number().over(one.orderBy(y, id_column)).cast("double").alias("b")).groupBy(*keys).agg(F.corr("a", "b").alias("rho"))


def resamples(df: DataFrame, unit: str, rounds: int, seed: int = 0) -> DataFrame:
    """round, unit, weight: how often each of the n units is drawn in a round of n draws. Draws are places in the order of units, from md5.

    Units are tasks or datasets, few by nature; their places come from one small window.
    """
    units = df.select(F.col(unit).alias("unit")).distinct()
    placed = units.withColumn("place", F.row_number().over(Window.orderBy("unit")) - 1)
    n = placed.count()
    draw = F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("boot"), F.col("round").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32) * n).cast("int")
    spark = df.sparkSession
    slots = spark.range(rounds).withColumnRenamed("id", "round").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return slots.select("round", draw.alias("place")).groupBy("round", "place").agg(F.count(F.lit(1)).alias("weight")).join(placed, "place").select("round", "unit", "weight")


def bootstrap_mean(df: DataFrame, unit: str, value: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """mean, and the 2.5 and 97.5 % quantiles of resampled means; p: share of resampled means not above 0."""
    totals = df.groupBy(F.col(unit).alias("unit")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    means = resamples(df, unit, rounds, seed).join(totals, "unit").groupBy("round").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))
    q = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p"))
    return df.agg(F.avg(value).alias("mean")).join(q)


def audit(reported: DataFrame, recomputed: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose value differs between two tables, or that one of them lacks."""
    both = reported.select(*keys, F.col(value).alias("reported")).join(recomputed.select(*keys, F.col(value).alias("recomputed")), keys, "full")
    return both.where(~F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= tolerance, F.lit(False)))


def relative_change(after: Column, clean: Column) -> Column:
    """100 (after - clean) / |clean|; null for a clean value of nothing."""
    return F.when(F.abs(clean) >= 1e-12, 100 * (after - clean) / F.abs(clean))


#: Thresholds of the removal rules: probabilities, parts of chance, of the most probable class, and of the class's mean self-confidence.
ABSOLUTE, OF_CHANCE, OF_TOP, OF_CLASS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5), (0.25, 0.5, 0.75, 1.0, 1.25), (0.5, 0.75, 1.0), (0.5, 0.75, 1.0)


def removal_rules(scores: DataFrame, probs: str, given: str, classes: int, k: int, id_column: str, mixture: Column | None = None) -> DataFrame:
    """id_column with a boolean a rule that marks rows for removal by the probability of their given label: bottom (the k least, ties to the smaller identifier), abs_, chance_, top_ and class_ with a threshold in hundredths, gmm where a column tells the rows of a mixture's lower part, and each of those united with bottom as <rule>_or_bottom.

    A class's mean self-confidence is the mean probability of the class over the rows given it.
    """
    rows = scores.select(id_column, F.col(given).alias("__given"), F.get(probs, F.col(given).cast("int")).alias("__p"), F.array_max(probs).alias("__top"), (mixture if mixture is not None else F.lit(None).cast("boolean")).alias("gmm"))
    means = rows.groupBy("__given").agg(F.avg("__p").alias("__mean"))  # a row a class
    rows = numbered(rows.join(F.broadcast(means), "__given"), ["__p", id_column], "__place")
    p, name = F.col("__p"), lambda kind, x: f"{kind}_{round(100 * x):03d}"
    rules = {name("abs", t): p < t for t in ABSOLUTE}
    rules |= {name("chance", a): p < a / classes for a in OF_CHANCE}
    rules |= {name("top", b): p < b * F.col("__top") for b in OF_TOP}
    rules |= {name("class", c): p < c * F.col("__mean") for c in OF_CLASS}
    rules |= {"gmm": F.col("gmm")} if mixture is not None else {}
    bottom = F.col("__place") <= k
    return rows.select(id_column, bottom.alias("bottom"), *(r.alias(n) for n, r in rules.items()), *((r | bottom).alias(f"{n}_or_bottom") for n, r in rules.items()))


def mask_vote(masks: DataFrame, row: str, mark: str, rank: str, k: int) -> DataFrame:
    """The k rows marked most often, ties by lower mean rank, then by row."""
    return masks.groupBy(row).agg(F.sum(F.col(mark).cast("int")).alias("votes"), F.avg(rank).alias("mean_rank")).orderBy(F.desc("votes"), "mean_rank", row).limit(k)


def standard_error_of_round(p: float, n: int) -> float:
    """Of a share from n resamples."""
    return math.sqrt(max(0.0, p * (1 - p)) / n) if n else math.nan
