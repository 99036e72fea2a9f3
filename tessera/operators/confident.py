"""Cross-fitting and confident learning: probabilities of rows from models of the other folds, the calibrated joint count of given and likely labels, and the rows that it says to prune.

A model is a function from learned and asked rows to a table of probabilities, or, for all
folds in one pass, the Gaussian model below: its sums are additive, so what a fold learns from
is the total less its own. Classes are few and checked; what is kept of them is K by K.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import key, uniform
from tessera.operators.ranks import numbered, numbered_within

#: (rows to learn from, rows to ask) -> DataFrame(identifier, probs), probabilities in the order of the classes.
Model = Callable[[DataFrame, DataFrame], DataFrame]
#: Most classes; tables of K by K numbers are held on the driver.
MOST_CLASSES = 1000
#: Fixed value: the least probability before normalisation.
LEAST = 1e-6


def classes_of(df: DataFrame, label: str) -> list:
    """The distinct labels in order, nulls left out; MOST_CLASSES at most."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    return sorted(found)


def dealt(df: DataFrame, k: int, id_column: str, seed: int = 0) -> DataFrame:
    """df with fold, 0 to k - 1: rows in key order are dealt round, so folds differ by one row at most."""
    keyed = df.withColumns({"__u": uniform(seed, "fold", id_column), "__key": key(seed, "fold", id_column)})
    return numbered(keyed, ["__u", "__key", id_column], "__place").withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).select(*df.columns, "fold")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shares(values: Column) -> Column:
    """An array over its sum."""
    return let(values, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(v, lambda x: x / s)))


def sound(probs: Column) -> Column:
    """Probabilities kept from 0 and normalised again."""
    return shares(F.transform(probs, lambda p: F.greatest(F.lit(LEAST), p)))


def out_of_fold(df: DataFrame, model: Model, k: int, id_column: str, anchors: DataFrame | None = None) -> DataFrame:
    """identifier, fold and probs of every row of df (with fold, see dealt), each from a model of the other folds and the anchors, which aren't asked."""
    parts = []
    for fold in range(k):
        learned = df.where(F.col("fold") != fold).drop("fold")
        if anchors is not None:
            learned = learned.unionByName(anchors)
        parts.append(model(learned, df.where(F.col("fold") == fold).drop("fold")).select(id_column, F.lit(fold).alias("fold"), sound(F.col("probs")).alias("probs")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gaussian_out_of_fold(df: DataFrame, vector: str, label: str, width: int, classes: Sequence, id_column: str) -> DataFrame:
    """identifier, fold, label and probs by independent Gaussians a class and entry, for all folds from one aggregate: a fold's model has the totals less the fold's own sums.

    Rows with a null label or vector are asked but not learned from; a null vector gives null probabilities.
    """
    x = F.col(vector)
    known = df.where(F.col(label).isNotNull() & x.isNotNull())
    own = known.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get(x, F.lit(i)).cast("double")).alias(f"s{i}") for i in range(width)), *(F.sum(F.pow(F.get(x, F.lit(i)).cast("double"), 2)).alias(f"q{i}") for i in range(width)))
    packed = own.select("fold", label, "n", F.array(*(f"s{i}" for i in range(width))).alias("s"), F.array(*(f"q{i}" for i in range(width))).alias("q"))
    zeros = F.array_repeat(F.lit(0.0), width)
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    less = lambda a, b: F.zip_with(a, b, lambda u, v: u - v)
    # a row a fold and class; both sides are that small
    folds = df.select("fold").distinct()
    total = packed.groupBy(label).agg(F.sum("n").alias("all"), F.collect_list(F.struct("s", "q")).alias("parts"))
    total = total.select(label, "all", F.aggregate("parts", zeros, lambda a, p: add(a, p["s"])).alias("ss"), F.aggregate("parts", zeros, lambda a, p: add(a, p["q"])).alias("qq"))
    every = folds.join(total, F.lit(True)).join(packed, ["fold", label], "left")
    n = F.col("all") - F.coalesce("n", F.lit(0))
    every = every.select("fold", label, n.alias("n"), less(F.col("ss"), F.coalesce("s", zeros)).alias("s"), less(F.col("qq"), F.coalesce("q", zeros)).alias("q")).where("n > 0")
    mean = F.transform("s", lambda v: v / F.col("n"))
    every = every.withColumn("mean", mean).withColumn("spread", F.zip_with("q", "mean", lambda q, m: F.greatest(F.lit(LEAST), q / F.col("n") - m * m)))
    constant = F.aggregate("spread", F.lit(0.0), lambda s, v: s + F.ln(v))
    models = every.select("fold", F.struct(F.col(label).alias("c"), (F.ln("n") - constant / 2).alias("constant"), "mean", "spread").alias("m")).groupBy("fold").agg(F.collect_list("m").alias("models"))
    score = lambda m: m["constant"] - F.aggregate(F.zip_with(F.zip_with(x, m["mean"], lambda a, b: (a - b) * (a - b)), m["spread"], lambda d, v: d / v), F.lit(0.0), lambda s, v: s + v) / 2
    asked = df.join(models, "fold", "left")
    scores = F.map_from_entries(F.transform("models", lambda m: F.struct(m["c"].alias("key"), score(m).alias("value"))))
    # classes that the fold's model doesn't know have no chance before probabilities are kept from 0
    raw = let(scores, lambda m: let(F.array_max(F.map_values(m)), lambda top: F.array(*(F.coalesce(F.exp(F.element_at(m, F.lit(c)) - top), F.lit(0.0)) for c in classes))))
    # kept, as thresholds, counts and ranks each read it, and so that they don't make the expression again
    return asked.select(id_column, "fold", label, F.when(x.isNotNull() & F.col("models").isNotNull(), sound(shares(raw))).alias("probs")).persist()


def fold_metrics(scored: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """fold, n, accuracy and cross-entropy of out-of-fold probabilities."""
    given = given_place(label, classes)
    hit = (F.array_position("probs", F.array_max("probs")) == given + 1).cast("double")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(-F.ln(F.get("probs", given))).alias("ce"))


def given_place(label: str, classes: Sequence) -> Column:
    """A row's place among the classes, from 0; null for others."""
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label))
    return F.when(place > 0, (place - 1).cast("int"))


def thresholds(scored: DataFrame, label: str, classes: Sequence) -> list[float]:
    """Per class the mean probability of it among the rows that are given it; 1 for classes of no row."""
    given = given_place(label, classes)
    found = {r.g: r.t for r in scored.groupBy(given.alias("g")).agg(F.avg(F.get("probs", given)).alias("t")).where("g is not null").collect()}
    return [found.get(i, 1.0) for i in range(len(classes))]


def likely(limits: Sequence[float]) -> Column:
    """The place of the class with the largest probability among those that reach their threshold, the first of equals; null if none does."""
    reached = F.zip_with("probs", F.array(*(F.lit(float(t)) for t in limits)), lambda p, t: F.when(p >= t, p))
    top = F.array_max(reached)
    return F.when(top.isNotNull(), F.array_position(reached, top).cast("int") - 1)


def calibrated(counts: Sequence[Sequence[int]], given: Sequence[int]) -> list[list[int]]:
    """The joint count scaled so that each row adds up to the rows given that class, in whole numbers by largest remainders (equal ones by class); each class is likely for one of its rows at least."""
    out = []
    for i, (row, n) in enumerate(zip(counts, given)):
        row = [max(1, c) if i == j else c for j, c in enumerate(row)]
        exact = [c / sum(row) * n for c in row]
        whole = [math.floor(x) for x in exact]
        order = sorted(range(len(row)), key=lambda j: (-(round(exact[j] - whole[j], 9)), j))
        for j in order[: n - sum(whole)]:
            whole[j] += 1
        if n and not whole[i]:  # one of its rows stays
            most = max(range(len(row)), key=lambda j: (whole[j], -j))
            whole[most] -= 1
            whole[i] += 1
        out.append(whole)
    return out


def joint(scored: DataFrame, label: str, classes: Sequence) -> list[list[int]]:
    """The calibrated joint count: rows by given class, columns by likely class."""
    limits = thresholds(scored, label, classes)
    pairs = scored.select(given_place(label, classes).alias("g"), likely(limits).alias("k")).where("g is not null").groupBy("g", "k").count().collect()
    k = len(classes)
    counts, given = [[0] * k for _ in range(k)], [0] * k
    for r in pairs:
        given[r.g] += r["count"]
        if r.k is not None:
            counts[r.g][r.k] = r["count"]
    return calibrated(counts, given)


def issues(scored: DataFrame, label: str, classes: Sequence, id_column: str) -> DataFrame:
    """identifier, quality (the probability of the given label), guess (the likeliest class) and issue.

    Of the rows given a class, as many as the joint count's cell for another class says are issues: those
    whose probability of the other exceeds the given one's most, ties by identifier; a row whose likeliest
    class is the given one is none. Rows with a null label or null probabilities are no issues.
    """
    spark, counts = scored.sparkSession, joint(scored.where("probs is not null"), label, classes)
    cells = [(g, k, n) for g, row in enumerate(counts) for k, n in enumerate(row) if g != k and n]
    rows = scored.select(id_column, given_place(label, classes).alias("g"), "probs")
    guess = F.array_position("probs", F.array_max("probs")).cast("int")
    shown = rows.select(id_column, F.get("probs", F.col("g")).alias("quality"), F.get(F.array(*map(F.lit, classes)), guess - 1).alias("guess"), (guess - 1 == F.col("g")).alias("same"))
    if not cells:
        return shown.select(id_column, "quality", "guess", F.lit(False).alias("issue"))
    table = spark.createDataFrame(cells, "g int, k int, most long")  # K by K rows at most
    asked = rows.where("probs is not null").join(F.broadcast(table), "g").select(id_column, "g", "k", "most", (F.get("probs", F.col("g")) - F.get("probs", F.col("k"))).alias("less"))
    flagged = numbered_within(asked, ["g", "k"], ["less", id_column], "__place").where(F.col("__place") <= F.col("most")).select(id_column).distinct()
    out = shown.join(flagged.withColumn("flag", F.lit(True)), id_column, "left")
    return out.select(id_column, "quality", "guess", F.coalesce(F.col("flag") & ~F.col("same"), F.lit(False)).alias("issue"))
