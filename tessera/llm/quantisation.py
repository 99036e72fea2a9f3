"""Approximate nearest neighbours by additive quantisation (operator 8).

A vector is approximated by a sum of codewords, one from each of M codebooks of
full dimension. Codebooks start as k-means on the residuals that the earlier ones
leave, and are then refitted together by least squares on beam-search codes.
Encoding keeps the best `beam` partial sums at each codebook. The index stores
codes and the norm of each approximation; a query scores rows by adding table
entries (its inner products with every codeword; for distances the stored norms
are added), and the best are scored again exactly on the original vectors.

Rows are dealt into lists by their nearest coarse centre, and lists into blocks. A
query goes to the lists whose centres it likes best, no more of them however many
rows there are. How many lists a query probes, and which part of a block's rows is
scored exactly, is measured on the sample against brute force: enough for all true
neighbours of nearly all queries there. Further rows of a block are scored as long as they
change the k best. Rows come in order of an optimistic score, the sum of table entries and
what the row's own error may add to it; rows with a larger error than any of the sample are
in blocks of their own, which every query meets and scores whole. Equal vectors count once.

Vectors are scaled by a power of two before they are rounded to single precision, so
no size of finite vectors overflows; exact scores use the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop, tasks, written


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


class Codebooks:
    """books: (M, K, dims) codewords."""

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, dtype=np.float32)
        self.m, self.k, self.dims = self.books.shape
        self.flat = self.books.reshape(-1, self.dims)
        self.gram = self.flat @ self.flat.T
        self.squares = np.einsum("ij,ij->i", self.flat, self.flat)

    def encode(self, x: np.ndarray, beam: int = 4, chunk: int = 512) -> np.ndarray:
        """Codes (n, M): at each codebook the `beam` sums with the least squared error go on."""
        out = np.empty((len(x), self.m), dtype=np.uint8)
        for at in range(0, len(x), chunk):
            part = np.asarray(x[at : at + chunk], dtype=np.float32)
            n = len(part)
            dot = part @ self.flat.T
            codes, error = np.zeros((n, 1, 0), dtype=np.int64), np.zeros((n, 1), dtype=np.float32)
            for m in range(self.m):
                own = slice(m * self.k, (m + 1) * self.k)
                cross = -2 * dot[:, None, own] + self.squares[own]
                for j in range(m):
                    cross = cross + 2 * self.gram[j * self.k + codes[:, :, j], own]
                total = (error[:, :, None] + cross).reshape(n, -1)
                width = min(beam, total.shape[1])
                best = np.argpartition(total, width - 1, axis=1)[:, :width]
                error = np.take_along_axis(total, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // self.k)[:, :, None], axis=1), (best % self.k)[:, :, None]], axis=2)
            out[at : at + n] = codes[np.arange(n), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(self.m))

    def table(self, query: np.ndarray) -> np.ndarray:
        """Inner products of one query with all codewords, (M, K)."""
        return (self.books @ query.astype(np.float32)).astype(np.float32)


def fit(x: np.ndarray, m: int = 16, k: int = 256, rounds: int = 6, refits: int = 1, seed: int = 0) -> Codebooks:
    """Codebooks from rows x: residual k-means, then least squares on their codes, `refits` times."""
    x = np.asarray(x, dtype=np.float32)
    rng, k = np.random.default_rng(seed), max(1, min(k, len(x)))
    residual, books = x.copy(), []
    for _ in range(m):
        books.append(_kmeans(residual, k, rounds, rng))
        residual -= books[-1][np.argmin((books[-1] ** 2).sum(1) - 2 * residual @ books[-1].T, axis=1)]
    found = Codebooks(np.stack(books))
    for _ in range(refits):
        codes = found.encode(x, beam=2).astype(np.int64) + np.arange(m) * k
        normal, right = np.zeros((m * k, m * k), dtype=np.float32), np.zeros((m * k, x.shape[1]), dtype=np.float32)
        for i in range(m):
            np.add.at(right, codes[:, i], x)
            for j in range(m):
                np.add.at(normal, (codes[:, i], codes[:, j]), 1.0)
        normal[np.diag_indices(m * k)] += 1.0
        right += found.flat  # a ridge towards the codewords so far
        solved = np.linalg.solve(normal, right).reshape(m, k, -1)
        del normal, right, codes, found  # each of some (m k)^2 numbers
        found = Codebooks(solved)
    return found


def usable(vector: Column, dims: int) -> Column:
    """True for vectors of this length without null or non-finite components that aren't zero throughout."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have (the least of them on a tie); 0 without vectors."""
    found = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


class Quantiser:
    """books; centres of the lists; scale (a power of two by which vectors are multiplied); probes (lists of a query); depth (part of a block's distinct vectors that is scored exactly at least); slack (part of a row's error that its optimistic score has); first (number of the first block of each list, the last one of rows with large errors); sizes (rows of each list)."""

    def __init__(self, books: Codebooks, centres: np.ndarray, scale: float, probes: int, depth: float, slack: float, first: list[int], sizes: list[int]):
        self.books, self.centres, self.scale, self.probes, self.depth, self.slack, self.first, self.sizes = books, centres, scale, probes, depth, slack, first, sizes

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * x @ self.centres.T, axis=1)

    def probed(self, query: np.ndarray, measure: str, rows: int) -> np.ndarray:
        """The lists of a scaled query, those it likes best first: `probes`, or more until they hold `rows`; then the list of large errors."""
        liked = self.centres @ query
        if measure == "l2":
            liked = 2 * liked - (self.centres**2).sum(1)
        order = np.argsort(-liked, kind="stable")
        enough = int(np.searchsorted(np.cumsum(np.asarray(self.sizes)[order]), rows)) + 1
        return np.append(order[: max(self.probes, enough)], len(self.centres))


def _own_scale(x: np.ndarray) -> np.ndarray:
    """x times the power of two that brings its largest component near 1."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _errors(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Lengths of what approximations leave."""
    return np.sqrt(((np.asarray(x, dtype=float) - kept) ** 2).sum(1))


def _measured(x: np.ndarray, books: Codebooks, centres: np.ndarray, k: int, beam: int, enough: float, measure: str) -> tuple[int, float, float]:
    """Probes with which all of the k nearest among the rows x are found for `enough` of up to 256 of them as queries, the depth that finds `enough` of them, and the slack of optimistic scores: the middle part of their errors by which the nearest were underrated."""
    asked = np.arange(0, len(x), max(1, len(x) // 256))
    kept, near = books.decode(books.encode(x, beam)), np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    off, found = _errors(x, kept), []
    for i in asked:
        exact, rough, liked = x @ x[i], kept @ x[i], centres @ x[i]
        if measure == "l2":
            exact, rough, liked = 2 * exact - (x**2).sum(1), 2 * rough - (kept**2).sum(1), 2 * liked - (centres**2).sum(1)
        exact[i], rough[i] = -np.inf, -np.inf
        found.append((i, rough, np.argsort(-exact, kind="stable")[: min(k, len(x) - 1)], exact, np.argsort(np.argsort(-liked, kind="stable"), kind="stable")))
    if len(x) < 2:
        return 1, 1.0, 0.0
    slack = 0.0
    if measure == "ip":
        slack = float(np.clip(np.median(np.concatenate([(exact[true] - rough[true]) / np.maximum(off[true] * np.linalg.norm(x[i]), 1e-300) for i, rough, true, exact, _ in found])), 0, 1))
    lists = np.sort([liked[near[true]].max() for _, _, true, _, liked in found])
    places = np.sort(np.concatenate([np.argsort(np.argsort(-(rough + slack * np.linalg.norm(x[i]) * off), kind="stable"), kind="stable")[true] for i, rough, true, _, _ in found]))
    at = lambda v: v[min(len(v) - 1, int(np.ceil(enough * len(v))))]
    return int(at(lists)) + 1, min(1.0, float(at(places) + 1) / len(x)), slack


def build(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", sample: int = 16384, m: int = 16, k: int = 256, beam: int = 4, block_rows: int = 8192, list_rows: int = 4096, seed: int = 0, near: int = 20, enough: float = 0.99, measure: str = "ip") -> tuple[DataFrame, Quantiser | None]:
    """The index of all usable rows, written to the shared folder: block, vec_id, vec (array of double), codes (binary), norm (squared norm of the approximation), off (length of its error; null where that is beyond the sample's).

    Codebooks and centres are fitted on at most `sample` rows, the ones with the least hash, an
    eighth of which only measures probes and depth if there are more rows than that. Rows whose
    identifier is null, or whose vector is null, of another length than most, zero or with null
    or non-finite components, are left out; rows that repeat an identifier are all kept.
    block_rows: about the most rows of a block; list_rows: about the rows of a list, of which
    there are at most sample / 16; measure: ip (largest inner product) or l2 (least distance).
    """
    dims = common_length(vectors, column)
    vec = F.col(column).cast("array<double>")
    rows = vectors.where(usable(vec, dims) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec"))
    order = F.xxhash64("vec_id", F.lit(seed))
    drawn = rows.orderBy(order, "vec_id", "vec").limit(sample).toPandas()
    if drawn.empty or not dims:
        return rows.select(F.lit(0).cast("long").alias("block"), "vec_id", "vec", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("off")).limit(0), None
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).first()
    power = -int(np.frexp(found.top)[1])
    x = np.ldexp(np.stack(drawn["vec"].to_list()), power)
    del drawn
    kept = len(x) - len(x) // 8 if found.n > len(x) and len(x) > 64 else len(x)
    lists = max(1, min(found.n // list_rows, sample // 16, kept // 4))
    centres = _kmeans(x[:kept].astype(np.float32), lists, 8, np.random.default_rng(seed + 1))
    books = fit(x[:kept], m, k, seed=seed)
    probes, depth, slack = _measured(x[kept:] if kept < len(x) else x, books, centres, near, beam, enough, measure)
    odd = max(float(_errors(x[i : i + 1024], books.decode(books.encode(x[i : i + 1024], beam))).max()) for i in range(0, len(x), 1024)) * 1.001
    del x
    shared = vectors.sparkSession.sparkContext.broadcast((books.books, centres))  # M * K * dims and at most sample / 16 * dims numbers

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, middles = Codebooks(shared.value[0]), shared.value[1]
        for batch in batches:
            if len(batch):
                scaled = np.ldexp(np.stack(batch["vec"].to_list()), power).astype(np.float32)
                codes = own.encode(scaled, beam)
                back = own.decode(codes).astype(float)
                off = _errors(scaled, back)
                owner = np.where(off > odd, len(middles), np.argmin((middles**2).sum(1) - 2 * scaled @ middles.T, axis=1))
                yield batch.assign(list=owner, codes=[c.tobytes() for c in codes], norm=(back**2).sum(1), off=np.where(off > odd, np.nan, off))

    spark = vectors.sparkSession
    coded = written(rows.mapInPandas(encode, "vec_id long, vec array<double>, list int, codes binary, norm double, off double"), "coded")
    counts = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # a row a list
    parts = [-(-counts.get(i, 0) // block_rows) for i in range(lists + 1)]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    places = spark.createDataFrame([(i, first[i], max(1, parts[i])) for i in range(lists + 1)], "list int, first long, parts long")
    index = coded.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), "parts")).alias("block"), "vec_id", "vec", "codes", "norm", "off")
    out = written(index, "codes")
    drop(coded)
    return out, Quantiser(books, centres, float(np.ldexp(1.0, power)), probes, depth, slack, first, [counts.get(i, 0) for i in range(lists)])


def search(index: DataFrame, quantiser: Quantiser | None, queries: DataFrame, *, k: int = 20, margin: float = 1.5, measure: str = "ip") -> DataFrame:
    """The k rows of the index nearest to each row (query_id, vec) of queries: query_id, rank from 1, vec_id, score (the inner product, or minus the squared distance).

    Rows with the query's own identifier are no candidates. `margin` times the measured probes
    are made, and one more. Of each block that a query meets,
    `margin` times the measured depth of its distinct vectors, 2 k at least, are scored
    exactly in double precision, and as many again while the last ones changed the k best. Ties
    in score go to the smaller vec_id. A query probes on until its lists hold 8 k rows. Queries
    repeated by identifier each count.
    """
    schema = "query_id long, vec_id long, score double"
    spark = index.sparkSession
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = min(len(quantiser.sizes), int(np.ceil(quantiser.probes * margin)) + 1)
    shared = spark.sparkContext.broadcast((quantiser.books.books, quantiser.centres, probes, quantiser.depth * margin, quantiser.slack, quantiser.first, quantiser.sizes))

    scale = quantiser.scale

    def scaled(vec: np.ndarray) -> np.ndarray:
        """A query as it meets codewords; for inner products its own length is of no matter."""
        return np.asarray(vec) * scale if measure == "l2" else _own_scale(np.asarray(vec))

    def opened() -> Quantiser:
        books, centres, probes, depth, slack, first, sizes = shared.value
        return Quantiser(Codebooks(books), centres, 1.0, probes, depth, slack, first, sizes)

    def sent(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = opened()
        for batch in batches:
            found = []
            for vec in batch["vec"]:
                found.append([b for i in own.probed(scaled(vec).astype(np.float32), measure, 8 * k) for b in range(own.first[i], own.first[i + 1])])
            yield batch.assign(blocks=found)

    def answer(block: pd.DataFrame, asked: pd.DataFrame, own: Quantiser) -> Iterator[pd.DataFrame]:
        block = block.sort_values("vec_id", kind="stable")
        names, vectors = block["vec_id"].to_numpy(), np.stack(block["vec"].to_list())
        alike, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        # of equal vectors only the first k + 1 identifiers can be among the k nearest
        spot = np.argsort(group, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(alike)))])[:-1]
        heads, group = spot[first], group[spot]
        spot = spot[(np.arange(len(spot)) - first[group]) <= k]
        group = group[(np.arange(len(group)) - first[group]) <= k]
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in block["codes"].iloc[heads]]).T.astype(np.intp)
        norms, off = block["norm"].to_numpy()[heads], block["off"].to_numpy()[heads]
        count = len(heads) if np.isnan(off).any() else min(len(heads), max(2 * k, int(np.ceil(own.depth * len(heads)))))
        starts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(heads)))])
        found = []
        for query, vec in zip(asked["vec_id"], asked["vec"], strict=True):
            vec = np.asarray(vec)
            near = scaled(vec)
            table = own.books.table(near)
            rough = table[0][codes[0]]
            for m in range(1, own.books.m):
                rough = rough + table[m][codes[m]]
            rough = 2 * rough - norms if measure == "l2" else rough + own.slack * np.linalg.norm(near) * off
            names_top, score_top, at = np.zeros(0, dtype=np.int64), np.zeros(0), 0
            while at < len(heads):
                size = min(count, len(heads) - at)
                if at == 0:
                    best = np.argpartition(-rough, size - 1) if size < len(rough) else np.arange(len(rough))
                elif at == count:
                    best = np.concatenate([best[:at], best[at:][np.argsort(-rough[best[at:]], kind="stable")]])
                chosen = best[at : at + size]
                rows = spot[np.concatenate([np.arange(starts[g], starts[g + 1]) for g in chosen])] if len(spot) > len(heads) else spot[chosen]
                rows = rows[names[rows] != query]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (vectors[rows] * vec).sum(axis=1) if measure == "ip" else -((vectors[rows] - vec) ** 2).sum(axis=1)
                before = names_top
                every, scores = np.concatenate([before, names[rows]]), np.concatenate([score_top, score])
                top = np.lexsort((every, -scores))[:k]
                names_top, score_top, at = every[top], scores[top], at + size
                if len(before) >= k and (top < len(before)).all():
                    break
            found.append(pd.DataFrame({"query_id": query, "vec_id": names_top, "score": score_top}))
        if found:
            yield pd.concat(found)

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, current, parts, block = opened(), None, [], None
        for batch in batches:
            for number, rows in batch.groupby("block", sort=False):
                if number != current:
                    current, parts, block = number, [], None
                parts.append(rows[rows["kind"] == 0])
                asked = rows[rows["kind"] == 1]
                if len(asked):
                    block = pd.concat(parts)
                    parts = [block]
                    if len(block):
                        yield from answer(block, asked, own)

    asked = queries.select(F.col("query_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).mapInPandas(sent, "vec_id long, vec array<double>, blocks array<long>")
    asked = asked.select(F.explode("blocks").alias("block"), "vec_id", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("off"), F.lit(1).alias("kind"))
    both = index.select("block", "vec_id", "vec", "codes", "norm", "off", F.lit(0).alias("kind")).unionByName(asked)
    near = both.repartition(max(tasks(spark), min(quantiser.first[-1], 1 << 14)), "block").sortWithinPartitions("block", "kind").mapInPandas(scan, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(vectors: DataFrame) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20. Of several rows of one identifier the least vector asks."""
    index, quantiser = build(vectors)
    return search(index, quantiser, index.where("vec_id % 20 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")))
