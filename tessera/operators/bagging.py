"""Bagged trees grown level by level from aggregates, their out-of-bag votes, and the filter of tables without anything to learn.

Rows stay where they are. A level is one aggregate of sums by tree, node, feature and bin, combined
before the shuffle; the best split of a node is found by running sums over its bins, and a row a
node comes back. A row's weight in a tree is a Poisson count keyed by tree and identifier, so a bag
is the same at any partitioning and the rows out of a tree's bag need no list. Targets are arrays:
one entry a class (1 for the own one) or one number, so that the gain is that of squared error.
"""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.keys import uniform
from tessera.operators.loops import cut

#: Most numbers of a forest; it is broadcast.
MOST_NUMBERS = 4_000_000
#: Accuracy of the quantiles that part bins; exact for fewer rows.
ACCURACY = 10_000


def poisson(u: Column, most: int = 12) -> Column:
    """The Poisson count of mean 1 at a uniform."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += p
        steps.append(total)
        p /= k + 1
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda b: b <= u))


def one_hot(label: str, classes: list) -> Column:
    """The label's target, null for a null label or one that isn't among the classes."""
    return F.when(F.col(label).isin(classes), F.array(*((F.col(label) == F.lit(c)).cast("double") for c in classes)))


def borders(df: DataFrame, vector: str, width: int, bins: int) -> list[list[float]]:
    """The distinct quantiles that part each entry into bins, by one aggregate; none for an entry without values."""
    asked = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.get(F.col(vector), F.lit(i)).cast("double"), asked, ACCURACY).alias(f"q{i}") for i in range(width))).first()
    return [sorted({v for v in q or [] if v - v == 0}) for q in row]


def coded(vector: str, parts: list[list[float]]) -> Column:
    """For each entry, how many borders are below it; -1 for a missing one, NaN beyond all."""
    table = F.from_json(F.lit(json.dumps(parts)), "array<array<double>>")
    at = lambda i: F.get(F.col(vector), i).cast("double")
    code = lambda i: F.when(at(i).isNull(), -1).otherwise(F.size(F.filter(F.get(table, i), lambda b: b < at(i))))
    return F.transform(F.sequence(F.lit(0), F.lit(len(parts) - 1)), code)


def tried(seed: int, tree: int, node: int, width: int, some: int) -> list[int]:
    """The features that a node chooses among, the first in the order of a key."""
    return sorted(sorted(range(width), key=lambda f: md5(f"{seed}|feature|{tree}|{node}|{f}".encode()).hexdigest())[:some])


class Forest:
    """features and cuts of nodes by tree (node k has children 2k, left for codes up to the cut, and 2k + 1; feature -1 ends), values of nodes."""

    def __init__(self, trees: int, depth: int, width: int):
        n = 2 << depth
        if trees * n * (width + 2) > MOST_NUMBERS:
            raise ValueError(f"a forest of {trees} trees of depth {depth} has more than {MOST_NUMBERS} numbers")
        self.features = [[-1] * n for _ in range(trees)]
        self.cuts = [[0] * n for _ in range(trees)]
        self.values: list[list[list[float] | None]] = [[None] * n for _ in range(trees)]

    def table(self, spark, asked: list | None = None) -> DataFrame:
        """A row a tree."""
        own = asked or [[] for _ in self.features]
        rows = list(zip(range(len(own)), self.features, self.cuts, self.values, own))
        return F.broadcast(spark.createDataFrame(rows, "tree int, features array<int>, cuts array<int>, values array<array<double>>, asked array<array<int>>"))


def _node(depth: int) -> Column:
    """The node at which a row's walk ends."""

    def step(k: Column, _: Column) -> Column:
        f = F.get(F.col("features"), k)
        return F.when(f < 0, k).otherwise(2 * k + (F.get(F.col("codes"), f) > F.get(F.col("cuts"), k)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(1), step) if depth else F.lit(1)


def grown(rows: DataFrame, width: int, targets: int, *, trees: int, depth: int, some: int, least: int, seed: int) -> Forest:
    """A forest from rows (codes, target, tree, weight); depth jobs of aggregates and one for the values."""
    spark, forest = rows.sparkSession, Forest(trees, depth, targets)
    learned = rows.where((F.col("weight") > 0) & F.col("target").isNotNull())
    sums = [F.sum("weight").alias("n"), *(F.sum(F.col("weight") * F.get("target", F.lit(j))).alias(f"s{j}") for j in range(targets))]
    line = Window.partitionBy("tree", "node", "feature")
    left = line.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(depth):
        first, end = 1 << level, 2 << level
        asked = [[tried(seed, t, k, width, some) for k in range(first, end)] for t in range(trees)]
        placed = learned.join(forest.table(spark, asked), "tree").withColumn("node", _node(level)).where(F.col("node") >= first)
        cells = placed.select("tree", "node", "weight", "target", "codes", F.explode(F.get("asked", F.col("node") - first)).alias("feature")).withColumn("code", F.get("codes", "feature"))
        counts = cells.groupBy("tree", "node", "feature", "code").agg(*sums)
        names = ["n", *(f"s{j}" for j in range(targets))]
        run = counts.select("tree", "node", "feature", "code", *(F.sum(c).over(left).alias(f"l{c}") for c in names), *(F.sum(c).over(line).alias(f"t{c}") for c in names))
        squares = lambda side, n: sum((F.pow(side(f"s{j}"), 2) for j in range(targets)), F.lit(0.0)) / n
        right = lambda c: F.col(f"t{c}") - F.col(f"l{c}")
        parted = run.where((F.col("ln") >= least) & (right("n") >= least))
        gain = squares(lambda c: F.col(f"l{c}"), F.col("ln")) + squares(right, right("n")) - squares(lambda c: F.col(f"t{c}"), F.col("tn"))
        # to nine digits, so that equal gains summed in another order stay ties: the smaller feature and code win
        best = parted.withColumn("gain", F.round(gain, 9)).where("gain > 0").groupBy("tree", "node").agg(F.max(F.struct("gain", -F.col("feature"), -F.col("code"))).alias("b"))
        for r in best.collect():  # a row a node
            forest.features[r.tree][r.node], forest.cuts[r.tree][r.node] = -r.b[1], -r.b[2]
    ends = learned.join(forest.table(spark), "tree").withColumn("node", _node(depth)).groupBy("tree", "node").agg(*sums)
    for r in ends.collect():
        forest.values[r.tree][r.node] = [r[f"s{j}"] / r["n"] for j in range(targets)]
    return forest


def out_of_bag(df: DataFrame, vector: str, target: Column, targets: int, *, width: int, id_column: str, trees: int = 25, depth: int = 6, bins: int = 16, some: int | None = None, least: int = 1, seed: int = 0) -> DataFrame:
    """identifier, target, trees (whose bag lacks the row), hits (of these, trees whose largest entry is the target's), predicted (their mean).

    Identifiers are distinct. A null vector or entry goes left at every node; a row with a null target
    is asked by every tree and learned by none. A row in every bag has trees 0 and predicted null.
    """
    parts = borders(df, vector, width, bins)
    rows = cut(df.select(F.col(id_column).alias("id"), coded(vector, parts).alias("codes"), target.alias("target")))
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    bagged = each.withColumn("weight", F.when(F.col("target").isNull(), 0).otherwise(poisson(uniform(seed, "bag", "tree", "id"))))
    forest = grown(bagged, width, targets, trees=trees, depth=depth, some=some or max(1, round(width**0.5)), least=least, seed=seed)
    asked = bagged.where("weight = 0").join(forest.table(df.sparkSession), "tree").select("id", "target", F.get("values", _node(depth)).alias("value")).where("value is not null")
    top = lambda c: F.array_position(c, F.array_max(c))
    votes = asked.groupBy("id").agg(F.count(F.lit(1)).alias("trees"), F.sum((top("value") == top("target")).cast("long")).alias("hits"), *(F.avg(F.get("value", F.lit(j))).alias(f"p{j}") for j in range(targets)))
    predicted = F.when(F.col("trees") > 0, F.array(*(f"p{j}" for j in range(targets))))
    return rows.select("id", "target").join(votes, "id", "left").select(F.col("id").alias(id_column), "target", F.coalesce("trees", F.lit(0)).alias("trees"), "hits", predicted.alias("predicted"))


def label_scores(votes: DataFrame, id_column: str) -> DataFrame:
    """identifier, trees, suspicion: minus the share of out-of-bag trees that give the row its label, -0.5 without trees."""
    known = votes.where(F.col("target").isNotNull())
    return known.select(id_column, "trees", F.when(F.col("trees") > 0, -F.col("hits") / F.col("trees")).otherwise(-0.5).alias("suspicion"))


def learnable(votes: DataFrame, targets: int, id_column: str, *, rounds: int = 200, trivial: float = 0.05, level: float = 0.05, seed: int = 0) -> DataFrame:
    """One row: n, baseline_mse (of the mean target), mse (out of bag), p (share of resamples without a gain), too_easy, unpredictable, rejected.

    Resamples are Poisson weights keyed by round and row, summed before the shuffle. Rows without a target
    or a prediction take no part; a table without any is unpredictable.
    """
    known = votes.where(F.col("target").isNotNull())
    base = known.agg(*(F.avg(F.get("target", F.lit(j))).alias(f"m{j}") for j in range(targets))).first()
    error = lambda at: sum((F.pow(F.get("target", F.lit(j)) - at(j), 2) for j in range(targets)), F.lit(0.0))
    mean = lambda j: F.lit(base[j]).cast("double")
    rows = cut(known.where(F.col("predicted").isNotNull()).select(F.col(id_column).alias("id"), error(mean).alias("b"), error(lambda j: F.get("predicted", F.lit(j))).alias("e")))
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", poisson(uniform(seed, "boot", "round", "id")))
    p = drawn.groupBy("round").agg(F.sum(F.col("w") * (F.col("b") - F.col("e"))).alias("gain")).agg(F.avg((F.col("gain") <= 0).cast("double"))).first()[0]
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("baseline_mse"), F.avg("e").alias("mse")).withColumn("p", F.lit(1.0 if p is None else p))
    easy = F.coalesce(F.sqrt("mse") <= trivial * F.sqrt("baseline_mse"), F.lit(False))
    return whole.withColumns({"too_easy": easy, "unpredictable": F.col("p") >= level}).withColumn("rejected", F.col("too_easy") | F.col("unpredictable"))
