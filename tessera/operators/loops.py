"""Iterative procedures: selection with refitting, beam and genetic search, and fixed-point estimates. Loops run on the driver over aggregated state; rows stay in Spark, and what a scorer gives is a table."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.keys import key
from tessera.operators import neighbours

#: (accepted rows, query rows) -> DataFrame(row_id, score); higher is better.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def knn_scorer(vector: str = "embedding", label: str = "label", k: int = 5, id_column: str = "row_id") -> Scorer:
    """The share of a query's k nearest accepted rows that have its label: a scorer without a model."""

    def score(accepted: DataFrame, queries: DataFrame) -> DataFrame:
        near = neighbours.knn(accepted, queries, k, id_column=id_column, vector=vector, carry=(label,), square=True)
        own = queries.select(F.col(id_column).cast("long").alias("query"), F.col(label).alias("own"))
        found = neighbours.agreement(near, own, label)
        return own.join(found, "query", "left").select(F.col("query").alias(id_column), (1 - F.coalesce("disagreement", F.lit(1.0))).alias("score"))

    return score


def schedule(left: int, step: int, how: str, amount: float) -> int:
    """Rows to accept in a step by what is left alone: all (oneshot), amount rows (m), a share of what is left (frac), or that share shrinking by half each step (shrink). Growth takes step_size, where frac and shrink are other formulas."""
    if how not in ("oneshot", "m", "frac", "shrink"):
        raise ValueError(f"unknown schedule {how!r}")
    if how == "oneshot":
        return left
    if how == "m":
        return min(left, int(amount))
    share = amount if how == "frac" else amount * 0.5**step
    return min(left, max(1, int(left * share)))


def step_size(how: str, amount: float, *, rows: int, accepted: int, left: int) -> int:
    """Rows to accept in a step, at least one and at most what is left to accept: all (oneshot), amount rows (m), amount percent of the pool's rows (pct), or amount as a share of the accepted set (frac), of what is left (shrink), or of the smaller of the two (both). Shares are rounded up."""
    sizes = {"oneshot": left, "m": int(amount), "pct": math.ceil(amount / 100 * rows), "frac": math.ceil(amount * accepted), "shrink": math.ceil(amount * left), "both": math.ceil(amount * min(accepted, left))}
    if how not in sizes:
        raise ValueError(f"unknown schedule {how!r}")
    return max(0, min(left, max(1, sizes[how])))


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the session's checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def greedy_growth(seeds: DataFrame, pool: DataFrame, scorer: Scorer, total: int, *, how: str = "frac", amount: float = 0.5, id_column: str = "row_id", rounds: int | None = None) -> DataFrame:
    """From the seeds on: score the rest of the pool with what is accepted, accept the best by step_size (ties to the smaller identifier), until `total` rows of the pool are in, or nothing is left to score; `rounds` steps at most, if given. Returns id_column, step."""
    accepted, taken, parts = seeds, 0, []
    rest = pool.join(seeds.select(id_column), id_column, "left_anti")
    rows, given = rest.count(), seeds.count()
    for step in count() if rounds is None else range(rounds):
        m = step_size(how, amount, rows=rows, accepted=given + taken, left=total - taken)
        if m <= 0:
            break
        best = cut(scorer(accepted, rest).orderBy(F.desc("score"), id_column).limit(m).select(id_column))
        got = best.count()
        if not got:
            break
        parts.append(best.withColumn("step", F.lit(step)))
        chosen = rest.join(best, id_column, "left_semi")
        accepted, rest, taken = cut(accepted.unionByName(chosen)), cut(rest.join(best, id_column, "left_anti")), taken + got
    out = parts[0] if parts else seeds.select(id_column, F.lit(0).alias("step")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def beam_search(start: frozenset, expand: Callable[[list[frozenset]], list[list[tuple[frozenset, float]]]], width: int, depth: int) -> tuple[frozenset, float]:
    """The best set found by keeping `width` sets a level, equal sets once. expand scores the successors of all beams as one batch."""
    beams: list[tuple[frozenset, float]] = [(start, float("-inf"))]
    best = beams[0]
    for _ in range(depth):
        found: dict[frozenset, float] = {}
        for children in expand([b for b, _ in beams]):
            for child, score in children:
                found[child] = max(score, found.get(child, float("-inf")))
        if not found:
            break
        beams = sorted(found.items(), key=lambda t: (-t[1], sorted(t[0])))[:width]
        best = max(best, beams[0], key=lambda t: t[1])
    return best


def genetic_search(n: int, budget: int, fitness: Callable[[list[frozenset]], list[float]], *, population: int = 20, generations: int = 10, mutation: float = 0.1, seed: int = 0) -> tuple[frozenset, float]:
    """The best subset of `budget` of n rows: tournaments, crossover within the union of the parents, mutation, repair to the budget. fitness is called with one batch a generation, each subset once."""
    r, known = random.Random(seed), {}

    def repaired(s: set) -> frozenset:
        s = set(s)
        while len(s) > budget:
            s.discard(r.choice(sorted(s)))
        while len(s) < min(budget, n):
            s.add(r.randrange(n))
        return frozenset(s)

    def scored(group: list[frozenset]) -> list[tuple[float, frozenset]]:
        new = [g for g in dict.fromkeys(group) if g not in known]
        known.update(zip(new, fitness(new), strict=True) if new else ())
        return [(known[g], g) for g in group]

    now = scored([repaired(set(r.sample(range(n), min(budget, n)))) for _ in range(population)])
    for _ in range(generations):
        children = [max(now, key=lambda t: t[0])[1]]
        while len(children) < population:
            a, b = (max(r.sample(now, min(3, len(now))), key=lambda t: t[0])[1] for _ in range(2))
            child = {x for x in a | b if r.random() < 0.5 or x in a & b}
            child = {x if r.random() >= mutation else r.randrange(n) for x in sorted(child)}
            children.append(repaired(child))
        now = scored(children)
    score, best = max(now, key=lambda t: t[0])
    return best, score


def em_prior(df: DataFrame, probs: str, trained: list[float], rounds: int = 100, tolerance: float = 1e-6) -> list[float]:
    """The class shares under which the classifier's probabilities, trained under other shares, agree with their own mean: one aggregate a round."""
    k = len(trained)
    prior = list(trained)
    for _ in range(rounds):
        ratio = F.array(*(F.lit(p / t) for p, t in zip(prior, trained)))
        weighted = F.zip_with(F.col(probs), ratio, lambda p, w: p * w)
        norm = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)
        row = df.select(weighted.alias("w"), norm.alias("s")).agg(*(F.avg(F.get("w", F.lit(i)) / F.col("s")).alias(f"p{i}") for i in range(k))).first()
        new = [row[f"p{i}"] for i in range(k)]
        moved = max(abs(a - b) for a, b in zip(new, prior))
        prior = new
        if moved < tolerance:
            break
    return prior


def two_gaussians(df: DataFrame, score: str, weight: float, rounds: int = 50) -> tuple[float, float, float, float]:
    """(mean, deviation) of a low and a high normal component with a fixed weight of the low one, by expectation maximisation: one aggregate a round."""
    r = df.agg(F.percentile(score, 0.25).alias("a"), F.percentile(score, 0.75).alias("b"), F.stddev_pop(score).alias("s")).first()
    m0, m1, s0, s1 = r.a, r.b, max(r.s, 1e-6), max(r.s, 1e-6)
    x = F.col(score)
    for _ in range(rounds):
        low = F.lit(weight / s0) * F.exp(-F.pow((x - m0) / F.lit(s0), 2) / 2)
        high = F.lit((1 - weight) / s1) * F.exp(-F.pow((x - m1) / F.lit(s1), 2) / 2)
        g = df.select(x.alias("x"), (low / (low + high + 1e-300)).alias("g"))
        r = g.agg(*(F.sum(e).alias(n) for n, e in (("n", F.col("g")), ("x1", F.col("g") * F.col("x")), ("x2", F.col("g") * F.col("x") ** 2), ("k", F.lit(1.0)), ("t1", F.col("x")), ("t2", F.col("x") ** 2)))).first()
        a, b = max(r.n, 1e-12), max(r.k - r.n, 1e-12)
        m0, m1 = r.x1 / a, (r.t1 - r.x1) / b
        s0 = max(np.sqrt(max(r.x2 / a - m0**2, 0.0)), 1e-6)
        s1 = max(np.sqrt(max((r.t2 - r.x2) / b - m1**2, 0.0)), 1e-6)
    return float(m0), float(s0), float(m1), float(s1)


def mass_threshold(df: DataFrame, weight: str, mass: float, steps: int = 60) -> float:
    """The t for which clipping weight - t to 0 .. 1 sums to the mass, by bisection: one aggregate a step of eight candidates."""
    r = df.agg(F.min(weight).alias("a"), F.max(weight).alias("b")).first()
    low, high = r.a - 1.0, r.b
    for _ in range(-(-steps // 3)):
        tries = [low + (high - low) * i / 8 for i in range(1, 8)]
        row = df.agg(*(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight) - F.lit(t)))).alias(f"t{i}") for i, t in enumerate(tries))).first()
        above = [t for i, t in enumerate(tries) if row[f"t{i}"] >= mass]
        below = [t for i, t in enumerate(tries) if row[f"t{i}"] < mass]
        low, high = max([low, *above]), min([high, *below])
    return (low + high) / 2


def best_checkpoint(df: DataFrame, run: str, rule: str = "loss") -> DataFrame:
    """The row of each run by held-out loss, or by accuracy or auc with ties to lower loss, always with ties to the earlier step; `last` is the last step."""
    order = {"loss": ["loss", "step"], "accuracy": [F.desc("accuracy"), "loss", "step"], "auc": [F.desc("auc"), "loss", "step"], "last": [F.desc("step")]}[rule]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where("__r = 1").drop("__r")


def seeded_subset(df: DataFrame, k: int, id_column: str, seed: int) -> DataFrame:
    return df.orderBy(key(seed, "subset", id_column)).limit(k)
