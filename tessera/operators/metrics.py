"""Metrics of classification, ranking and calibration as aggregates over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranks import cumulated

#: Least probability in a logarithm.
CLAMP = 1e-12


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(empty))


def argmax(probs: Column | str) -> Column:
    """The first class with the largest probability."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top) / F.lit(float(temperature))))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.transform(p, lambda v: ratio(v, total))


def reweighted(probs: str, shares: list[float]) -> Column:
    """Probabilities over class shares, normalised again."""
    return normalised(F.zip_with(F.col(probs), F.array(*map(F.lit, shares)), lambda p, s: p / s))


def cross_entropy(probs: str, label: str) -> Column:
    return -F.avg(F.ln(F.greatest(F.get(F.col(probs), F.col(label)), F.lit(CLAMP))))


def confusion(predicted: str, label: str) -> list[Column]:
    """tn, fp, fn, tp."""
    p, y = F.col(predicted), F.col(label)
    return [F.count_if((p == a) & (y == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1), ("tp", 1, 1))]


def from_counts(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, balanced accuracy and Matthews correlation beside tn, fp, fn, tp; undefined ones are 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    margin = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    sides = F.when(tp + fn > 0, 1.0).otherwise(0.0) + F.when(tn + fp > 0, 1.0).otherwise(0.0)
    return df.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": ratio(ratio(tp, tp + fn) + ratio(tn, tn + fp), sides),
        "mcc": ratio(tp * tn - fp * fn, margin),
    })


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """auc per group: the share of pairs of a positive and a negative in the right order, ties half; null without a side.

    Counts per distinct score come first, so a window only runs over the distinct scores of a group.
    """
    keys = by or []
    bins = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) == 0).cast("double").alias("q"))
    if keys:
        below = F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before_q", F.coalesce(below, F.lit(0.0)))
    else:
        bins = cumulated(bins, [score], ["q"])
    return bins.withColumn("u", F.col("p") * (F.col("before_q") + F.col("q") / 2)).groupBy(*keys).agg(ratio(F.sum("u"), F.sum("p") * F.sum("q"), None).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """ap per group: precision at each distinct score, weighted by the recall it adds."""
    keys = by or []
    bins = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    if keys:
        down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(down), F.lit(0.0)) for c in ("p", "n")})
    else:
        bins = cumulated(bins.withColumn("__down", -F.col(score)), ["__down"], ["p", "n"])
    return bins.withColumn("u", F.col("p") * (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))).groupBy(*keys).agg(ratio(F.sum("u"), F.sum("p"), None).alias("ap"))


def cumulative_shares(df: DataFrame, score: str, label: str, id_column: str) -> DataFrame:
    """df with accepted and positives: along ascending scores, ties by identifier, the share of rows and of positives so far."""
    found = cumulated(df.withColumn("__one", F.lit(1).cast("long")), [score, id_column], ["__one", label])
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    return found.select(*df.columns, ((F.col("before___one") + 1) / F.lit(whole.n)).alias("accepted"), ratio((F.col(f"before_{label}") + F.col(label)).cast("double"), F.lit(whole.p), None).alias("positives"))


def at_k(df: DataFrame, score: str, label: str, k: int, id_column: str) -> DataFrame:
    """precision and recall among the k largest scores, ties to the smaller identifier."""
    top = df.orderBy(F.desc(score), id_column).limit(k).agg(F.count_if(F.col(label) == 1).cast("double").alias("hit"), F.count(F.lit(1)).alias("k"))
    whole = df.agg(F.count_if(F.col(label) == 1).cast("double").alias("positives"))
    return top.join(whole).select(ratio(F.col("hit"), F.col("k")).alias("precision"), ratio(F.col("hit"), F.col("positives")).alias("recall"))


def calibration_bins(df: DataFrame, confidence: str, correct: str, low: float = 0.5, bins: int = 10) -> DataFrame:
    """Per bin of confidence from low to 1, the last closed: bin, n, confidence, accuracy."""
    b = F.least(F.floor((F.col(confidence) - low) / ((1 - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def multiclass_mcc(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """The correlation of predicted and true classes over all classes, 0 if a side has one class."""
    pair = df.groupBy(predicted, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = pair.agg(F.sum("n").alias("s"), F.sum(F.when(F.col(predicted) == F.col(label), F.col("n")).otherwise(0.0)).alias("c"))
    p = pair.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("p"))
    t = pair.groupBy(F.col(label).alias("k")).agg(F.sum("n").alias("t"))
    sums = p.join(t, "k", "full").fillna(0.0, ["p", "t"]).agg(F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("t") ** 2).alias("tt"))
    s2 = F.col("s") ** 2
    return whole.join(sums).select(ratio(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))).alias("mcc"))


def brier(probability: str, label: str) -> Column:
    return F.avg((F.col(probability) - F.col(label)) ** 2)


def entropy(probs: str) -> Column:
    """Entropy over its largest value."""
    p = F.col(probs)
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(F.when(v > 0, v))).otherwise(0.0)) / F.ln(F.size(p).cast("double"))


def margin(probs: str) -> Column:
    s = F.sort_array(F.col(probs), asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def transaction_cost(wrong: float = 5.0, missed: float = 60.0) -> Column:
    """(wrong * (tp + fp) + missed * fn) / missed over tn, fp, fn, tp."""
    return (wrong * (F.col("tp") + F.col("fp")) + missed * F.col("fn")) / F.lit(missed)


def sweep(df: DataFrame, probability: str, label: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts and metrics at each threshold. Rows are counted once by label and place among the sorted thresholds; those few counts are added up to each threshold."""
    levels = sorted(set(map(float, thresholds)))
    place = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col(probability)))
    counts = df.where(F.col(probability).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    own = counts.select("y", "place", "n", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("at")) for i, t in enumerate(levels)))).alias("x")).select("y", "n", "x.threshold", (F.col("place") > F.col("x.at")).alias("p"))
    cell = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n"))), F.lit(0))
    return from_counts(own.groupBy("threshold").agg(cell(0, False).alias("tn"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(1, True).alias("tp")))


def plateau(best: list[tuple[float, float]], within: float = 0.002) -> float:
    """The middle of the longest run of thresholds whose score lies within `within` of the best, the first of several."""
    top = max(s for _, s in best)
    runs: list[list[float]] = [[]]
    for t, s in sorted(best):
        if s >= top - within:
            runs[-1].append(t)
        elif runs[-1]:
            runs.append([])
    longest = max(runs, key=len)
    return (longest[0] + longest[-1]) / 2


def temperatures(df: DataFrame, logits: str, label: str, values: list[float]) -> DataFrame:
    """Cross entropy at each temperature, in one aggregate."""
    columns = [(-F.avg(F.ln(F.greatest(F.get(softmax(logits, t), F.col(label)), F.lit(CLAMP))))).alias(f"t{i}") for i, t in enumerate(values)]
    wide = df.agg(*columns)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("loss")) for i, t in enumerate(values)))).alias("x")).select("x.*")


def vote(df: DataFrame, row: str, label: str, weight: str) -> DataFrame:
    """Per row the label with the larger summed weight, the smaller label on a tie."""
    sums = df.groupBy(row, label).agg(F.sum(weight).alias("w"))
    rank = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("w"), label))
    return sums.withColumn("__r", rank).where("__r = 1").drop("__r")


def ensemble_average(df: DataFrame, row: str, probs: str) -> DataFrame:
    """Per row the mean over its members of each class's probability, as an array."""
    long = df.select(row, F.posexplode(probs).alias("k", "p")).groupBy(row, "k").agg(F.avg("p").alias("p"))
    return long.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x.p).alias(probs))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
