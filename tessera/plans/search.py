"""Queries of searches over all embeddings: half of the rows by a beam, and a set under a budget by a genetic search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search as se
from tessera.sources.tables import table


def _pool(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("x"), F.col("label"))


def beam_selection(spark, sf_dir):
    """Half of the embeddings, an eighth a step, nearest to the mean of those accepted."""
    pool = _pool(spark, sf_dir)
    n = pool.count()
    return se.beam_search(pool, se.centroid_losses(), n // 2, width=2, branches=2, step=max(1, n // 8)).rows


def genetic_selection(spark, sf_dir):
    """A quarter of the embeddings at most whose mean differs most from the mean of all."""
    pool = _pool(spark, sf_dir)
    mean = pool.agg(F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(8))).alias("m")).first().m

    def values(p, members):
        own = members.join(p, "row").groupBy("candidate").agg(*(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(8)))
        return own.select("candidate", F.round(sum(F.pow(F.col(f"m{i}") - F.lit(mean[i]), 2) for i in range(8)), 12).alias("value"))

    return se.genetic_search(pool, values, max(1, pool.count() // 4), population=6, generations=2).rows.select("row")


QUERIES = {f.__name__: f for f in (beam_selection, genetic_selection)}
ORACLES: dict[str, str] = {}
