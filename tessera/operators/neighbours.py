"""Exact nearest neighbours and the data-quality scores built on them.

The query set is stated by the caller and meets all candidates in blocks: candidates
stay where they are, queries are sent to them in packed blocks, and each block keeps its
k best, so what is shuffled is k rows a query and candidate partition, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that a block of candidates meets at a time.
BLOCK = 512
#: Most numbers of a product of queries and candidates.
PRODUCT = 1 << 22
#: Most tasks that rank all candidates, as each is sent all of them.
RANKING = 64
#: Candidates whose differences from a query are taken at a time.
CHUNK = 2048


def knn(candidates: DataFrame, queries: DataFrame, k: int | None, *, id_column: str, vector: str, metric: str = "euclidean", carry: tuple[str, ...] = (), exclude_self: bool = True, parts: int | None = None, square: bool = False, within: str | None = None, mean_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query, rank (from 1), neighbour, distance and the carried columns of the neighbour: the k nearest, ties to the smaller identifier.

    metric: euclidean or cosine (1 - cosine). Distances are in double precision. k: None ranks all candidates.
    square: queries are about as many as candidates, so both are dealt into blocks and a task has a pair of blocks.
    within: a carried column of both sides; the k nearest of each of its values but null and the query's, ranked for each.
    mean_of: for k None, a function of a query's ranking that gives a number a rank: of the matches in rank order, 1.0 where
    the neighbour's carried column equals the query's, 0.0 where not, NaN where either is null. Then only neighbour and value return, the mean over queries.
    """
    spark = candidates.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if mean_of is not None:
        if k is not None or len(carry) != 1:
            raise ValueError("mean_of needs k None and one carried column")
        return _means(candidates, queries, mean_of, id_column, vector, metric, carry[0], exclude_self, parts or min(n, RANKING))
    blocks = max(1, round(n**0.5)) if square else 1
    parts = max(1, n // blocks)
    own_part = F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int")
    if blocks > 1:
        own_part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int") * blocks + b))
    asked_part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda c: c * blocks + F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(blocks)).cast("int")))
    own = candidates.select(own_part.alias("part"), F.lit(0).alias("kind"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.struct(*(F.col(c) for c in carry), F.lit(0).alias("_")).alias("more"))
    own = own.withColumn("asker", F.lit(None).cast(candidates.schema[within].dataType if within else "int"))
    sent = queries.select(asked_part.alias("part"), F.lit(1).alias("kind"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast(own.schema["more"].dataType).alias("more"), (F.col(within) if within else F.lit(None).cast("int")).alias("asker"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema["more"].dataType.fields)

    def nearest(names: np.ndarray, x: np.ndarray, asked: pd.DataFrame) -> Iterator[tuple]:
        q = np.stack(asked["v"].to_list())
        every, whole, xx, qq = names, x, (x * x).sum(1), (q * q).sum(1)
        # squares by one product choose what could be among the k nearest; distances come from differences below
        rough = k is not None and metric == "euclidean" and len(x) > 4 * k and np.isfinite(xx).all() and np.isfinite(qq).all()
        step = max(1, PRODUCT // max(1, len(x)))
        for i, name in enumerate(asked["id"]):
            at = np.arange(len(every))
            if rough:
                if i % step == 0:
                    squares = xx - 2 * (q[i : i + step] @ whole.T) + qq[i : i + step, None]
                own = squares[i % step]
                if exclude_self:
                    own[every == name] = np.inf
                at = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1] + 1e-11 * (xx.max() + qq[i]))
            names, x = every[at], whole[at]
            if metric == "cosine":
                d = 1 - (x * q[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q[i] * q[i]).sum()))
            else:
                d = np.sqrt(((x - q[i]) ** 2).sum(1))
            d = np.where(np.isnan(d) | (names == name) & exclude_self, np.inf, d)
            some = np.argpartition(d, k - 1)[:k] if k is not None and len(d) > k else np.arange(len(d))
            some = np.flatnonzero(d <= d[some].max()) if len(some) else some
            for j in some[np.lexsort((names[some], d[some]))][:k]:
                if np.isfinite(d[j]):
                    yield name, at[j], d[j]

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, ready = None, [], None
        for batch in batches:
            for number, own_rows in batch.groupby("part", sort=False):
                if number != part:
                    part, rows, ready = number, [], None
                rows.append(own_rows[own_rows["kind"] == 0])
                asked = own_rows[own_rows["kind"] == 1]
                if not len(asked):
                    continue
                if ready is None or len(rows) > 1:
                    whole = pd.concat(rows)
                    rows = [whole]
                    ready = (whole["id"].to_numpy(), np.stack(whole["v"].to_list()) if len(whole) else None, whole["more"].to_list())
                    values = pd.Series([m[within] for m in ready[2]] if within else [], dtype=object)
                    places = [(value, at.to_numpy()) for value, at in values.groupby(values).groups.items()]
                    classes = [(value, at, ready[0][at], ready[1][at]) for value, at in places]
                if ready[1] is None:
                    continue
                for at in range(0, len(asked), BLOCK):
                    some = asked.iloc[at : at + BLOCK]
                    found = list(nearest(ready[0], ready[1], some)) if within is None else []
                    for value, place, names, x in classes:
                        others = some[some["asker"].notna() & (some["asker"] != value)]
                        if len(others):
                            found += [(name, place[j], d) for name, j, d in nearest(names, x, others)]
                    if found:
                        more = pd.DataFrame([ready[2][j] for _, j, _ in found])
                        yield pd.DataFrame({"query": [a for a, _, _ in found], "neighbour": [ready[0][j] for _, j, _ in found], "distance": [d for _, _, d in found]}).join(more)

    both = own.unionByName(sent).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")
    near = both.mapInPandas(scan, f"query long, neighbour long, distance double, {kinds}").drop("_")
    rank = F.row_number().over(Window.partitionBy("query", *([within] if within else [])).orderBy("distance", "neighbour"))
    ranked = near.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _means(candidates: DataFrame, queries: DataFrame, mean_of: Callable[[np.ndarray], np.ndarray], id_column: str, vector: str, metric: str, label: str, exclude_self: bool, parts: int) -> DataFrame:
    """neighbour and value (see knn). A task has some of the queries and all candidates, ranks these for one query after the other and gives
    a sum a candidate, so what is shuffled is the candidates once for each of a fixed number of tasks, and never pairs.
    """
    kind = "array<float>" if dict(candidates.dtypes)[vector] == dict(queries.dtypes)[vector] == "array<float>" else "array<double>"
    dealt = lambda df, part, asked: df.where(F.col(vector).isNotNull()).select(part.alias("part"), F.lit(asked).alias("asked"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(parts)).cast("int")
    both = dealt(candidates, every, False).unionByName(dealt(queries, own, True)).repartitionById(parts, F.col("part"))

    def read(batches: list[pa.RecordBatch]) -> tuple:
        vectors = [b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for b in batches]
        labels = pa.chunked_array([b.column("label") for b in batches])
        return np.concatenate([b.column("id").to_numpy() for b in batches]), vectors, labels.to_numpy(), labels.is_null().to_numpy()

    def distances(vectors: list[np.ndarray], q: np.ndarray, out: np.ndarray) -> None:
        at = 0
        for piece in vectors:
            for start in range(0, len(piece), CHUNK):
                x = piece[start : start + CHUNK].astype(float)
                for i in range(len(q)):
                    if metric == "cosine":
                        out[i, at : at + len(x)] = 1 - (x * q[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q[i] * q[i]).sum()))
                    else:
                        out[i, at : at + len(x)] = np.sqrt(((x - q[i]) ** 2).sum(1))
                at += len(x)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        for batch in batches:
            for asked in held:
                some = batch.filter(pc.equal(batch.column("asked"), asked))
                if len(some):
                    held[asked].append(some)
        if not held[False] or not held[True]:
            return
        names, vectors, labels, unknown = read(held[False])
        asked_names, q, own_labels, own_unknown = read(held[True])
        q = np.concatenate(q).astype(float)
        by_name = np.argsort(names, kind="stable")
        names, labels, unknown = names[by_name], labels[by_name], unknown[by_name]
        total, count, seen = np.zeros(len(names)), np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        together = np.argsort(asked_names, kind="stable")  # rows of one name are one query
        step, at = max(1, PRODUCT // len(names)), 0
        while at < len(together):
            rows = together[at : at + step]
            rows = together[at : np.searchsorted(asked_names[together], asked_names[rows[-1]], "right")]
            at += len(rows)
            found = np.empty((len(rows), len(names)))
            with np.errstate(all="ignore"):
                distances(vectors, q[rows], found)
            found = found[:, by_name]
            for name in np.unique(asked_names[rows]):
                own = np.flatnonzero(asked_names[rows] == name)
                d, place, row = found[own].ravel(), np.tile(np.arange(len(names)), len(own)), np.repeat(rows[own], len(names))
                part = np.flatnonzero(np.isfinite(d) & (names[place] != name) if exclude_self else np.isfinite(d))
                order = np.argsort(d[part])
                ranked = d[part][order]
                if (ranked[1:] == ranked[:-1]).any():  # ties to the smaller name
                    order = np.argsort(d[part], kind="stable") if len(own) == 1 else np.lexsort((place[part], d[part]))
                place, row = place[part][order], row[part][order]
                value = mean_of(np.where(unknown[place] | own_unknown[row], np.nan, labels[place] == own_labels[row]))
                known = ~np.isnan(value)
                total += np.bincount(place[known], value[known], len(names))
                count += np.bincount(place[known], minlength=len(names))
                seen[place] = True
        for start in range(0, len(names), 1 << 16):
            some = np.flatnonzero(seen[start : start + (1 << 16)]) + start
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some]), pa.array(count[some])], ["neighbour", "s", "n"])

    found = both.mapInArrow(sums, "neighbour long, s double, n long").groupBy("neighbour").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return found.select("neighbour", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("value"))


def hub_scores(near: DataFrame) -> DataFrame:
    """Mean distance to the neighbours."""
    return near.groupBy("query").agg(F.avg("distance").alias("score"))


def agreement(near: DataFrame, own: DataFrame, label: str = "label") -> DataFrame:
    """query and disagreement: 1 - the share of neighbours that have the query's label. own: query, own."""
    return near.join(own, "query").groupBy("query").agg((1 - F.avg((F.col(label) == F.col("own")).cast("double"))).alias("disagreement"))


def vote(near: DataFrame, label: str = "label") -> DataFrame:
    """query, label and share of the most frequent label among the neighbours, the smaller on a tie."""
    counts = near.groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("query")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(one)).withColumn("__r", F.row_number().over(one.orderBy(F.desc("n"), label))).where("__r = 1").select("query", label, "share")


def relabelled(near: DataFrame, own: DataFrame, share: float, label: str = "label") -> DataFrame:
    """query, own and new: the neighbours' majority label where it reaches the share, else the own one."""
    return own.join(vote(near, label), "query", "left").select("query", "own", F.when(F.col("share") >= share, F.col(label)).otherwise(F.col("own")).alias("new"))


def boundary_margin(near: DataFrame, label: str = "label") -> DataFrame:
    """query, first, second and margin of the labels with the most weight exp(-distance / median distance)."""
    median = near.agg(F.percentile_approx("distance", 0.5, 1_000_000).alias("m")).first().m or 1.0
    w = near.groupBy("query", label).agg(F.sum(F.exp(-F.col("distance") / F.lit(median))).alias("w"))
    total = F.sum("w").over(Window.partitionBy("query"))
    ranked = w.withColumn("w", F.col("w") / total).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("w"), label)))
    return ranked.groupBy("query").agg(F.max(F.when(F.col("r") == 1, F.col(label))).alias("first"), F.max(F.when(F.col("r") == 2, F.col(label))).alias("second"), (F.max(F.when(F.col("r") == 1, F.col("w"))) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0))).alias("margin"))


def shapley(near: DataFrame, own: DataFrame, k: int, label: str = "label") -> DataFrame:
    """neighbour and value: each candidate's mean share in k-nearest-neighbour accuracy over all queries. near ranks all candidates of each query.

    From the farthest on, a candidate differs from the one behind it by (match - next match) / k * min(k, rank) / rank; the last has match / n.
    """
    matched = near.join(own, "query").withColumn("m", (F.col(label) == F.col("own")).cast("double"))
    one = Window.partitionBy("query")
    behind = F.lead("m").over(one.orderBy("rank"))
    term = F.when(behind.isNull(), F.col("m") / F.col("rank") * F.least(F.lit(1.0), F.col("rank") / F.lit(k))).otherwise((F.col("m") - behind) / F.lit(k) * F.least(F.lit(k), F.col("rank")) / F.col("rank"))
    stepped = matched.withColumn("t", term)
    value = F.sum("t").over(one.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("s", value).groupBy("neighbour").agg(F.avg("s").alias("value"))


def shapley_values(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same shares for knn's mean_of: of one query, from its matches in rank order."""

    def values(m: np.ndarray) -> np.ndarray:
        rank = np.arange(1.0, len(m) + 1)
        behind = np.append(m[1:], np.nan)
        term = np.where(np.isnan(behind), m / rank * np.minimum(1.0, rank / k), (m - behind) / k * np.minimum(k, rank) / rank)
        known = ~np.isnan(term)
        s = np.cumsum(np.where(known, term, 0.0)[::-1])[::-1]
        return np.where(np.logical_or.accumulate(known[::-1])[::-1], s, np.nan)

    return values


def spread_labels(near: DataFrame, seeds: DataFrame, alpha: float = 0.9, rounds: int = 10) -> DataFrame:
    """query, label, weight after `rounds` of spreading the seeds' labels (query, label) along the neighbour graph: alpha of the neighbours' mean, 1 - alpha of the seed."""
    start = seeds.select("query", "label", F.lit(1.0).alias("weight"))
    state = start
    for _ in range(rounds):
        moved = near.select("query", "neighbour").join(state.select(F.col("query").alias("neighbour"), "label", "weight"), "neighbour")
        mean = moved.groupBy("query", "label").agg(F.sum("weight").alias("w")).join(near.groupBy("query").agg(F.count(F.lit(1)).alias("d")), "query")
        state = mean.select("query", "label", (F.col("w") / F.col("d") * alpha).alias("weight")).unionByName(start.withColumn("weight", F.lit(1 - alpha))).groupBy("query", "label").agg(F.sum("weight").alias("weight"))
        state = state.checkpoint() if state.sparkSession.conf.get("spark.checkpoint.dir", None) else state
    return state


def nearest_other_class(candidates: DataFrame, queries: DataFrame, k: int, *, id_column: str, vector: str, label: str, classes: list) -> DataFrame:
    """query, label, distance: the class other than the query's whose k nearest are nearest on average, the smaller on a tie. Classes are few."""
    own = queries.select(F.col(id_column).cast("long").alias("query"), F.col(label).alias("own"))
    near = knn(candidates.where(F.col(label).isin(classes)), queries, k, id_column=id_column, vector=vector, carry=(label,), within=label)
    every = near.groupBy("query", label).agg(F.avg("distance").alias("distance"))
    best = F.row_number().over(Window.partitionBy("query").orderBy("distance", label))
    return every.withColumn("r", best).where("r = 1").join(own, "query").select("query", "own", label, "distance")
