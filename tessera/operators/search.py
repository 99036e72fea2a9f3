"""Beam and genetic search for sets of rows, kept as tables of (candidate, row).

Rows are accepted, crossed, mutated and cut to a budget in Spark; the driver sees a number, a
digest and a score for each candidate, so as many values as there are candidates in a level,
never a set. Digests don't depend on the order of rows: equal sets are found by them. Scorers
are called once a level, for all candidates.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import uniform
from tessera.operators.loops import cut
from tessera.operators.ranks import numbered_within

#: (pool, members (candidate, row), candidates (candidate)) -> (candidate, row, loss) of the rows of the pool that aren't members; lower is better.
Losses = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: (pool, members (candidate, row)) -> (candidate, value) of each candidate that has rows.
Values = Callable[[DataFrame, DataFrame], DataFrame]


def centroid_losses(vector: str = "x") -> Losses:
    """The squared distance of a row to the mean of the members, of all rows where there are none: losses without a model."""

    def losses(pool: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
        n = pool.select(F.max(F.size(vector))).first()[0] or 0
        mean = F.array(*(F.avg(F.get(vector, F.lit(i))) for i in range(n))).alias("mean")
        every = pool.agg(mean).first()["mean"]  # one vector
        means = members.join(pool, "row").groupBy("candidate").agg(mean)
        own = candidates.join(means, "candidate", "left").select("candidate", F.coalesce("mean", F.array(*map(F.lit, every))).alias("mean"))
        # a copy of the pool for each candidate of a level, whose number is a parameter
        rows = pool.select("row", vector).join(own, F.lit(True)).join(members.select("candidate", "row"), ["candidate", "row"], "left_anti")
        d = F.aggregate(F.zip_with(vector, "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return rows.select("candidate", "row", d.alias("loss"))

    return losses


def _digest() -> list[Column]:
    """Order-free sums over rows that tell sets apart."""
    return [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("row")).alias("bits"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("sum")]


def gumbel(seed: int, stream: str, *row: Column | str) -> Column:
    u = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), uniform(seed, stream, *row)))
    return -F.ln(-F.ln(u))


@dataclass(frozen=True)
class Found:
    """The best set: rows (row, step: the level in which it was accepted), its value, and the levels."""

    rows: DataFrame
    value: float
    levels: int


def beam_search(pool: DataFrame, losses: Losses, total: int, *, width: int = 4, branches: int = 3, step: int = 1, tau: float = 0.1, seed: int = 0, values: Values | None = None) -> Found:
    """`total` rows of the pool (row and what losses needs), all if it has fewer, accepted `step` at a time from none on.

    Each of `width` beams branches `branches` ways: its `step` rows of least loss, and draws of as many by the
    Gumbel-top-m rule at temperature tau, keyed by row; with one row a step the next best rows in turn. Equal sets
    count once, with the lower path (the sum of losses). The `width` best by path, or by `values`, stay; ties to the
    smaller digest.
    """
    spark = pool.sparkSession
    pool = pool.where(F.col("row").isNotNull()).dropDuplicates(["row"])
    goal = min(total, pool.count())
    members = spark.createDataFrame([], "candidate long, row long, step int")
    known = {0: (0.0, (0, 0, 0))}  # of each beam the path and the digest
    taken = level = 0
    while taken < goal:
        m = min(step, goal - taken)
        beams = spark.createDataFrame([(k, p) for k, (p, _) in known.items()], "candidate long, path double")
        scored = cut(losses(pool, members.select("candidate", "row"), beams.select("candidate")))
        ways = scored.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(branches - 1 if m > 1 else 0))))
        drawn = F.col("loss") / F.lit(tau) - gumbel(seed, f"beam|{level}", "way", "candidate", "row")
        placed = numbered_within(ways.withColumn("order", F.when(F.col("way") == 0, F.col("loss")).otherwise(drawn)), ["candidate", "way"], ["order", "row"], "place")
        if m > 1:
            picked = placed.where(F.col("place") <= m)
        else:
            picked = placed.where(F.col("place") <= branches).withColumn("way", (F.col("place") - 1).cast("int"))
        picked = cut(picked.select("candidate", "way", "row", "loss"))
        found = picked.groupBy("candidate", "way").agg(F.sum("loss").alias("cost"), *_digest()).collect()  # width times branches rows
        sets: dict[tuple, tuple[float, int, int]] = {}
        for r in sorted(found, key=lambda r: (r.candidate, r.way)):
            path, (size, bits, total_) = known[r.candidate]
            digest = (size + r.size, bits ^ r.bits, total_ + int(r["sum"]))
            if digest not in sets or path + r.cost < sets[digest][0]:
                sets[digest] = (path + r.cost, r.candidate, r.way)
        numbers = list(sets)
        links = spark.createDataFrame([(sets[d][1], sets[d][2], k) for k, d in enumerate(numbers)], "candidate long, way int, child long")
        new = picked.join(F.broadcast(links), ["candidate", "way"]).select(F.col("child").alias("candidate"), "row", F.lit(level).alias("step"))
        old = members.join(F.broadcast(links), "candidate").select(F.col("child").alias("candidate"), "row", "step")
        children = cut(old.unionByName(new))
        rank = {k: sets[d][0] for k, d in enumerate(numbers)}
        if values is not None:
            rank = {r.candidate: r.value for r in values(pool, children.select("candidate", "row")).collect()}
        best = sorted(range(len(numbers)), key=lambda k: (rank[k], numbers[k]))[:width]
        table = spark.createDataFrame([(k, i) for i, k in enumerate(best)], "candidate long, beam long")
        members = cut(children.join(F.broadcast(table), "candidate").select(F.col("beam").alias("candidate"), "row", "step"))
        known = {i: (sets[numbers[k]][0], numbers[k]) for i, k in enumerate(best)}
        value, taken, level = rank[best[0]], taken + m, level + 1
    return Found(members.where("candidate = 0").select("row", "step"), value if level else 0.0, level)


def genetic_search(pool: DataFrame, values: Values, budget: int, *, population: int = 16, generations: int = 10, elite: int = 2, tournament: int = 3, crossover: float = 0.9, mutation: float | None = None, patience: int = 8, seed: int = 0) -> Found:
    """The set of one to `budget` rows of the pool (row and what values needs) with the largest value found.

    Sets begin as rows of least keyed noise, half the budget to all of it. A generation keeps the `elite` best;
    every other set has two parents by tournament, takes each row from either by a keyed coin (crossover) or
    copies the first, turns each row of the pool with the mutation rate (one over its rows), and loses rows by keyed noise until it fits
    the budget; an empty one gets the row of least noise. Sets are valued once, by digest. Stops after `patience`
    generations without a better one (0: never).
    """
    spark = pool.sparkSession
    pool = pool.where(F.col("row").isNotNull()).dropDuplicates(["row"])
    n = pool.count()
    if not n:
        return Found(spark.createDataFrame([], "row long, step int"), 0.0, 0)
    if budget < 1 or population < 2 or not 0 <= elite < population or tournament < 1:
        raise ValueError("need a budget, two sets or more, fewer elite ones, and a tournament")
    r, rate, known = random.Random(seed), 1 / n if mutation is None else mutation, {}
    rows, cap = pool.select(F.col("row").cast("long").alias("row")), min(budget, n)
    coin = lambda stream: uniform(seed, stream, "candidate", "row")

    def fitting(wanted: DataFrame, generation: int) -> DataFrame:
        """candidate, row: of the rows wanted of each candidate (limit: how many it may keep) those of least noise."""
        noisy = wanted.withColumn("noise", coin(f"repair|{generation}"))
        return cut(numbered_within(noisy, ["candidate"], ["noise", "row"], "place").where(F.col("place") <= F.col("limit")).select("candidate", "row"))

    def valued(members: DataFrame) -> dict[int, float]:
        digests = {d.candidate: (d.size, d.bits, int(d["sum"])) for d in members.groupBy("candidate").agg(*_digest()).collect()}  # a row a set
        first = {}
        for k, d in sorted(digests.items()):
            if d not in known:
                first.setdefault(d, k)
        if first:
            asked = spark.createDataFrame([(k,) for k in first.values()], "candidate long")
            got = {v.candidate: float(v.value) for v in values(pool, members.join(F.broadcast(asked), "candidate", "left_semi")).collect()}
            known.update({d: got[k] for d, k in first.items()})
        return {k: known[d] for k, d in digests.items()}

    sizes = [(k, r.randint(max(1, cap // 2), cap)) for k in range(population)]
    members = fitting(rows.join(F.broadcast(spark.createDataFrame(sizes, "candidate long, limit int")), F.lit(True)), -1)
    now, stale, levels = valued(members), 0, 0
    for generation in range(generations):
        order = sorted(now, key=lambda k: (-now[k], k))
        top = now[order[0]]
        pick = lambda: min(r.sample(range(population), min(tournament, population)), key=lambda k: (-now[k], k))
        plan = [(i, k, k, False) for i, k in enumerate(order[:elite])] + [(i, pick(), pick(), r.random() < crossover) for i in range(elite, population)]
        parents = spark.createDataFrame(plan, "child long, a long, b long, cross boolean")
        side = lambda c: members.join(F.broadcast(parents), F.col("candidate") == F.col(c)).select(F.col("child").alias("candidate"), "row", F.lit(c == "a").alias("first"), "cross")
        held = side("a").unionByName(side("b")).groupBy("candidate", "row").agg(F.max("first").alias("in_a"), F.max(~F.col("first")).alias("in_b"), F.first("cross").alias("cross"))
        taken = held.where(F.when(F.col("cross") & (coin(f"cross|{generation}") < 0.5), F.col("in_b")).otherwise(F.col("in_a"))).select("candidate", "row")
        numbers = spark.createDataFrame([(i,) for i in range(elite, population)], "candidate long")
        turned = rows.join(F.broadcast(numbers), F.lit(True)).where(coin(f"mutate|{generation}") < rate)  # a copy of the pool's numbers a set
        both = taken.unionByName(turned).groupBy("candidate", "row").agg(F.count(F.lit(1)).alias("often")).where("often = 1")
        full = both.select("candidate", "row", F.lit(cap).alias("limit"))
        filled = full.select("candidate").distinct()
        empty = numbers.join(filled, "candidate", "left_anti").join(rows, F.lit(True)).select("candidate", "row", F.lit(1).alias("limit"))
        members = fitting(full.unionByName(empty), generation)
        now, levels = valued(members), generation + 1
        stale = 0 if max(now.values()) > top else stale + 1
        if patience and stale >= patience:
            break
    best = min(now, key=lambda k: (-now[k], k))
    return Found(members.where(F.col("candidate") == best).select("row", F.lit(levels).alias("step")), now[best], levels)
