"""Mixing of sources to target weights by cube-method balanced sampling (operator 3).

Each source gets a target number of words. A document is then taken
floor(target / size of its source) times, and once more with the fraction that is
left as its inclusion probability. The cube method turns those probabilities into
zeros and ones: it moves the vector of probabilities along the null space of two
balancing constraints, the source's taken documents and its taken words, until
every probability but a few is 0 or 1 (flight). Expected values never change and
both totals are kept exactly on the way. A block of documents leaves at most two
fractional ones; those of many blocks meet in blocks of the next level, until each
source has one block, whose last one or two documents are decided so that the
word total moves least (landing).

Rows equal in source, doc_id and text form one unit, which enters the flight with the
fraction that its expected number of chosen rows leaves.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, fresh, written

#: A probability this near to 0 or 1 counts as decided.
NEAR = 1e-9


def size_sql(column: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source of units (source, size, n): n_units, source_size, target.

    Sources in code point order, null last, weigh weights in turn, and share the sum of all
    sizes by weight. A target stops at `most` times its source's size, and the rest shares the
    excess by weight until none is above: targets are least(cap, level * weight) for one level.
    """
    sources = written(units.groupBy("source").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    # windows over a row a source
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("double"))
    ranked = written(ranked.withColumn("cap", F.col("source_size").cast("double") * most), "weights")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    found = ranked.select(F.col("cap"), F.col("weight"), level.alias("level")).where("level * weight <= cap").agg(F.min_by("level", F.col("cap") / F.col("weight")).alias("level")).first()
    return ranked.select("source", "n_units", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(float(found.level or 0.0))).alias("target"))


def fly(p: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight: moves p, keeping sum(p * docs) and sum(p * words), until at most two entries are fractional."""
    p = p.tolist()
    d, w = docs.tolist(), words.tolist()
    draws = rng.random(len(p) + 2).tolist()
    live: list[int] = []
    for k in range(len(p) + 1):
        while len(live) == 3:
            a, b, c = live
            u = (d[b] * w[c] - d[c] * w[b], d[c] * w[a] - d[a] * w[c], d[a] * w[b] - d[b] * w[a])
            if not any(u):  # constraints in proportion: two entries exchange what they weigh
                u = (d[b], -d[a], 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u, strict=True) if x)
            step = up if draws[k] * (up + down) < down else -down
            for i, x in zip(live, u, strict=True):
                p[i] += step * x
                if p[i] < NEAR or p[i] > 1 - NEAR:
                    p[i] = float(round(p[i]))
            before = len(live)
            live = [i for i in live if 0 < p[i] < 1]
            if len(live) == before:  # rounding left the entry that should have arrived beside its bound
                i = min(live, key=lambda j: min(p[j], 1 - p[j]))
                p[i] = float(round(p[i]))
                live.remove(i)
        if k < len(p) and 0 < p[k] < 1:
            live.append(k)
    return np.array(p)


def land(p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last fractional entries: pairs by the coupling of their probabilities whose word total strays least, one left over by a draw."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    for a, b in zip(left[::2], left[1::2], strict=False):
        off = [[((i - p[a]) * words[a] + (j - p[b]) * words[b]) ** 2 for j in (0, 1)] for i in (0, 1)]
        low, high = max(0.0, p[a] + p[b] - 1), min(p[a], p[b])
        both = low if off[1][1] + off[0][0] > off[1][0] + off[0][1] else high
        u = rng.random()
        p[a], p[b] = (1, 1) if u < both else (1, 0) if u < p[a] else (0, 1) if u < p[a] + p[b] - both else (0, 0)
    if len(left) % 2:
        p[left[-1]] = float(rng.random() < p[left[-1]])
    return p


def balanced_choice(units: DataFrame, seed: int = 0, block: int = 4096) -> DataFrame:
    """units (source, doc_id, size, print, n, p, n_units) with extra, the number of their n rows that are chosen, by the cube method within each source; a task holds one block of about `block` units.

    Of a unit's n rows floor(p * n) are chosen for sure, and one more with the fraction that is left.
    """

    def decide(level: int):
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["h", "doc_id", "size", "print"], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, int(rows["h"].iloc[0]) & (1 << 63) - 1, len(rows)])
            words = rows["size"].to_numpy(dtype=float)
            p = fly(rows["p"].to_numpy(dtype=float), np.ones(len(rows)), words, rng)
            if rows["blocks"].iloc[0] == 1:
                p = land(p, words, rng)
            return rows.assign(p=p)

        return one

    left = units.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "print")).withColumn("blocks", F.ceil(F.col("n_units") / block).cast("long"))
    left = left.withColumn("sure", F.floor(F.col("p") * F.col("n") + NEAR).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("p") * F.col("n") - F.col("sure")))
    left = left.withColumn("p", F.when(F.col("p") < NEAR, 0.0).otherwise(F.col("p")))
    most = left.agg(F.max("blocks")).first()[0] or 1
    fields = ["source", "doc_id", "size", "print", "n", "sure", "p", "h", "blocks"]
    done = []
    for level in range(99):
        grouped = left.select(*fields).withColumn("block", F.pmod(F.shiftright(F.xxhash64("h", F.lit(level)), 8), F.col("blocks")))
        flown = grouped.groupBy("source", "block").applyInPandas(decide(level), grouped.schema).drop("block")
        flown = written(flown, f"flight{level}")
        done.append(flown.where("p in (0, 1)"))
        if most == 1:
            break
        left = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("long"))
        most = math.ceil(2 * most / block)
    return reduce(DataFrame.unionByName, done).select("source", "doc_id", "size", "print", "n", (F.col("sure") + F.col("p").cast("long")).alias("extra"))


def mix(docs: DataFrame, *, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per unit of docs (doc_id, source, text), that is rows equal in those: source, doc_id, size, print (hash of the text), n (rows of the unit), source_size, target, base (times that each row is taken) and extra (of the n rows, those taken once more); no row is taken more than `most` times.

    A null text has size 0, as has one without words; such documents are taken or left like
    others and add no words. Null sources are one source, last in order; null identifiers are
    told apart by text. Texts of any length are counted whole. Further columns are ignored. An
    empty table gives an empty result. Reruns with one seed agree.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size_sql().alias("size"), _print().alias("print"))
    units = written(sized.groupBy("source", "doc_id", "size", "print").agg(F.count(F.lit(1)).alias("n")), "units")
    targets = written(source_targets(units, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "n_units", "source_size", "target", rate.alias("rate"))
    aimed = aimed.withColumn("p", F.col("rate") - F.floor("rate"))
    chosen = balanced_choice(aimed, seed)
    return chosen.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "doc_id", "size", "print", "n", "source_size", "target", F.floor(rate).cast("long").alias("base"), "extra")


def _print() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as its unit in mixed says; of several rows of a unit, which may differ in further columns, the least ones are taken once more."""
    source, doc, mark, n, base, extra, times, own, before = (fresh(f"__{c}", docs.columns) for c in ("source", "doc", "mark", "n", "base", "extra", "times", "own", "before"))
    plain = [f"`{c}`" for c in docs.columns]
    units = mixed.where("base > 0 or extra > 0").select(F.col("source").alias(source), F.col("doc_id").alias(doc), F.col("print").alias(mark), F.col("n").alias(n), F.col("base").alias(base), F.col("extra").alias(extra))
    left = docs.withColumn(own, _print())
    rows = left.join(units, F.col("source").cast("string").eqNullSafe(F.col(source)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark)))
    even = rows.where((F.col(extra) == 0) | (F.col(extra) == F.col(n))).select(*plain, (F.col(base) + (F.col(extra) > 0).cast("long")).alias(times))
    # rows of a unit that aren't taken alike: equal ones are counted first, so that a unit of many is no burden
    odd = rows.where((F.col(extra) > 0) & (F.col(extra) < F.col(n))).groupBy(*plain, mark, base, extra).agg(F.count(F.lit(1)).alias(own))
    order = Window.partitionBy("source", "doc_id", mark).orderBy(*plain).rowsBetween(Window.unboundedPreceding, -1)
    odd = odd.withColumn(before, F.coalesce(F.sum(own).over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col(own), F.col(extra) - F.col(before)))
    odd = odd.select(*plain, (F.col(base) * F.col(own) + more).alias(times)).where(F.col(times) > 0)
    return even.unionAll(odd).withColumn(before, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*plain)


def op3_mix(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken, size times its copies."""
    found = mix(docs).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    found = found.withColumn("copies", F.col("base") + (F.col("k") <= F.col("extra")).cast("long"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
