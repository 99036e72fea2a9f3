"""Labels spread over a neighbour graph to the end: the symmetric normalised system is solved over the edge table.

The system's eigenvalues lie within 1 - alpha and 1 + alpha whatever the graph, so a Chebyshev iteration
needs no sums over all rows: a step is one join of the edges with a row a node and one sum a node, and
the number of steps for an accuracy is known before the first. A row holds a number a class.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.loops import cut

#: Steps between writes of the state.
STRIDE = 4


def _checked(spark: SparkSession) -> None:
    """Has steps end their lineage: without a checkpoint folder a local session takes a temporary one, a cluster is refused."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))


def edges(near: DataFrame) -> DataFrame:
    """a, b, s from a neighbour table (query, neighbour, distance): weights exp(-(distance / median)^2), the larger of both directions, over the roots of both ends' sums."""
    median = max(near.agg(F.percentile_approx("distance", 0.5, 1_000_000)).first()[0] or 0.0, 1e-12)
    w = F.exp(-F.pow(F.col("distance") / F.lit(median), 2))
    one = near.select(F.col("query").alias("a"), F.col("neighbour").alias("b"), w.alias("w"))
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")))
    sums = both.groupBy("a").agg(F.greatest(F.sum("w"), F.lit(1e-300)).alias("da"))
    ends = sums.select(F.col("a").alias("b"), F.col("da").alias("db"))
    return cut(both.join(sums, "a").join(ends, "b").select("a", "b", (F.col("w") / F.sqrt("da") / F.sqrt("db")).alias("s")))


def steps_for(alpha: float, accuracy: float) -> int:
    """Steps after which the error's bound is below the accuracy, of the first error."""
    root = math.sqrt((1 + alpha) / (1 - alpha))
    return max(1, math.ceil(math.log(accuracy / 2) / math.log((root - 1) / (root + 1))))


def solved(nodes: DataFrame, near: DataFrame, classes: list, *, alpha: float = 0.9, accuracy: float = 1e-7) -> DataFrame:
    """query and probs (by the order of classes) for every row of nodes (query, label; null for rows without a seed).

    Solves (1 - alpha * S) F = (1 - alpha) * seeds. What is below 0 counts as 0; a row that no seed reaches has equal
    probabilities. Labels outside the classes are no seeds; identifiers are distinct; an empty table gives none.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    _checked(nodes.sparkSession)
    k, s = len(classes), edges(near)
    seed = F.array(*(F.coalesce((F.col("label") == F.lit(c)).cast("double"), F.lit(0.0)) * (1 - alpha) for c in classes))
    zeros = F.array_repeat(F.lit(0.0), k)
    state = cut(nodes.select("query", zeros.alias("x"), seed.alias("r"), seed.alias("d")))
    combined = lambda a, p, b, q: F.zip_with(a, b, lambda u, v: u * F.lit(p) + v * F.lit(q))
    rho, n = alpha, steps_for(alpha, accuracy)
    for i in range(n):
        sent = s.join(state.select(F.col("query").alias("b"), "d"), "b")
        sums = sent.groupBy("a").agg(*(F.sum(F.col("s") * F.get("d", F.lit(j))).alias(f"m{j}") for j in range(k)))
        met = state.join(sums.select(F.col("a").alias("query"), F.array(*(f"m{j}" for j in range(k))).alias("m")), "query", "left")
        after = met.select("query", combined(F.col("x"), 1.0, F.col("d"), 1.0).alias("x"), combined(combined(F.col("r"), 1.0, F.col("d"), -1.0), 1.0, F.coalesce("m", zeros), alpha).alias("r"), "d")
        later = 1 / (2 / alpha - rho)
        state = after.select("query", "x", "r", combined(F.col("d"), later * rho, F.col("r"), 2 * later / alpha).alias("d"))
        rho = later
        if (i + 1) % STRIDE == 0 or i + 1 == n:
            state = cut(state)
    # a row's numbers as columns, so that a lambda makes none of them again for every entry
    kept = state.select("query", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    summed = kept.withColumn("t", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return summed.select("query", F.when(F.col("t") > 1e-300, F.transform("x", lambda v: v / F.col("t"))).otherwise(F.array_repeat(F.lit(1.0 / max(1, k)), k)).alias("probs"))
