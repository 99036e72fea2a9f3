"""Exact similarity join on word shingles with count-vector R-trees (operator 5).

The counts of a set's hashes in equal ranges are a point. Two sets share at most the sum
of the smaller of their counts, and a set shares with none below a node of an R-tree of
points more than the sum of the minima of its counts and the node's upper corner. So a
tree yields the pairs that could be similar, and those are verified on the words.

One tree can't be searched by many tasks without each task meeting most of it: the bound
only separates sets that differ much, and any two leaves of sets of like size could hold a
similar pair. Trees are therefore built in cells, in which every similar pair meets. The
hashes of a set fall into groups, more than the hashes in which it can differ from a similar
set; so of any `lack + 1` groups one holds the same hashes in both. A key names the content
of a group. Of the keys of a set the `lack + 1` rarest ones in the whole table are enough,
as long as all sets agree on an order of keys: a set that has so many keys of its own has no
similar one, and a passage common to many texts brings nothing together unless a text is
made of little else. Sets with a key in common are a cell.

Sets that are equal are one class. Classes that verified pairs connect are components, and
a pair is only verified while its classes are in different ones. All pairs come from trees.
In the first rounds each class asks the tree of its cell, or of its block of a large one, for
one partner: of those that the bound allows, in other components, the one in most cells. That
joins near copies in rows that grow with the cells, not with pairs. Then trees find what is
left: within a cell, the classes outside its largest component search those of all others.

Hashes have 64 bits (words in lanes of eight bytes, each through a finished mixer); sizes of
sets rely on them, links are decided on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop, fresh, marked, sifted, tasks, tidy, written

#: Most coordinates of a point.
COORDINATES = 4096
#: Groups of the largest sets of a level for each hash in which those can differ.
SPARE = 1.15
#: Sets in a leaf of a tree, and the most of a cell on either side of a task.
LEAF, BLOCK = 32, 2048
#: Rounds in which classes ask trees for one partner before they ask for all that are left. They save work and change no result.
ROUNDS = 3
#: Bytes of text hashed at a time, and the sets that a task remembers to give keys of equal ones once.
CHUNK, SEEN = 1 << 20, 200_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    """A text in UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of UTF-8 bytes start, and their hashes: lanes of eight bytes, each mixed with its place in the word, their sum mixed with the word's length."""
    gap = _SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    letters = np.flatnonzero(~gap)
    lengths = np.bincount(first.cumsum()[letters] - 1, minlength=len(starts))
    lanes = (lengths + 7) >> 3
    base = np.concatenate([[0], lanes.cumsum()])
    room = np.zeros(base[-1] * 8, dtype=np.uint8)
    room[letters + np.repeat(base[:-1] * 8 - starts, lengths)] = data[letters]
    place = np.arange(base[-1], dtype=np.uint64) - np.repeat(base[:-1], lanes).astype(np.uint64)
    mixes = mixed(room.view("<u8") ^ mixed(place + np.uint64(0x9E3779B97F4A7C15)))
    return starts, mixed(np.add.reduceat(mixes, base[:-1]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: Iterable[str | None], n: int = 4) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words, A-Z lower-cased; with fewer words, of the whole run; none without words."""
    parts, held = [], 0
    for text in texts:
        parts.append(lowered(text))
        held += len(parts[-1])
        if held > CHUNK:
            yield from _chunk(parts, n)
            parts, held = [], 0
    yield from _chunk(parts, n)


def _chunk(parts: list[bytes], n: int) -> Iterator[np.ndarray]:
    starts, words = _words(np.frombuffer(b" ".join(parts), dtype=np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    at = np.searchsorted(starts, offsets)

    def runs(part: np.ndarray, size: int) -> np.ndarray:
        total = np.full(len(part) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = mixed(total + part[k : len(part) - size + 1 + k])
        return total

    whole = runs(words, n) if len(words) >= n else words
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        else:
            yield runs(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, n: int = 4) -> np.ndarray:
    return next(shingle_sets([text], n))


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = lowered(text).split()  # at space and tab to carriage return
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def _lack(size: int, level: int, percent: int) -> int:
    """Most hashes in which a set of this size differs from a similar one below the top of a level."""
    other = min(size * 100 // percent, (2 << level) - 1)
    return (size + other) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=256)
def _borders(level: int, percent: int) -> np.ndarray:
    """The least hash of each group of the sets with 2 ** level hashes or more, up to twice as many, and of the sets one level below that could be similar to them."""
    top = _lack((2 << level) - 1, level, percent)
    m = max(top + 1, int(np.ceil(top * SPARE)))
    return np.array([-(-(g << 32) // m) << 32 for g in range(m)], dtype=np.uint64)


def keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Keys of the groups of a set, at its own level and, if a similar set can be there, at the next; and for even and odd levels how many of the set's keys there may be left out.

    Bit 0 of a key tells even levels from odd ones. Groups are ranges of the hash; empty ones
    have keys, marked in bit 1, only where there are too few others.
    """
    size, out, spare = len(hashes), [], [0, 0]
    own = size.bit_length() - 1
    sums = np.concatenate([[np.uint64(0)], mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).cumsum(dtype=np.uint64)])
    for level in [own, own + 1] if size * 100 // percent >= 2 << own else [own]:
        lack = _lack(size, level, percent)
        if not lack:  # similar sets of this level are equal ones
            continue
        borders = _borders(level, percent)
        border = np.append(np.searchsorted(hashes, borders), size)
        filled = border[1:] > border[:-1]
        kept = np.flatnonzero(filled)
        if len(kept) <= lack:
            kept = np.arange(len(borders))
        spare[level & 1] = len(kept) - lack - 1
        content = sums[border[kept + 1]] - sums[border[kept]]
        key = mixed(content + mixed((np.uint64(level) << np.uint64(32)) + kept.astype(np.uint64)))
        out.append((key & ~np.uint64(3)) | (~filled[kept]).astype(np.uint64) << np.uint64(1) | np.uint64(level & 1))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)).view(np.int64), (spare[0], spare[1])


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    return keys(hashes, percent)[0]


def point(hashes: np.ndarray) -> np.ndarray:
    """Numbers of hashes in equal ranges, as many as the power of two below the size, 8 to COORDINATES."""
    bits = min(max(len(hashes).bit_length() - 1, 3), COORDINATES.bit_length() - 1)
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _packed(p: np.ndarray) -> bytes:
    """A point as bytes, whose first tells the width of a count."""
    width = 1 if p.max() < 1 << 8 else 2 if p.max() < 1 << 16 else 4
    return bytes([width]) + p.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int32)


def together(points: list[np.ndarray]) -> np.ndarray:
    """Points with as many coordinates as the shortest: neighbouring ranges are added up."""
    n = min(map(len, points))
    return np.stack([p if len(p) == n else p.reshape(n, -1).sum(1) for p in points])


class CountTree:
    """A packed R-tree of count vectors; a node keeps its upper corner and its range of sizes.

    The lower corner is not needed: the bound on the overlap grows with the counts.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(1)
        # packed by size, then by the coordinate that varies most among sets of a size
        slab = np.argsort(self.sizes, kind="stable")
        by = int(points.std(0).argmax()) if len(points) else 0
        wide = LEAF * max(1, int(np.sqrt(len(points) / LEAF)))
        self.order = np.concatenate([part[np.argsort(points[part, by], kind="stable")] for part in (slab[i : i + wide] for i in range(0, len(slab), wide))]) if len(points) else slab
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low, top = points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at)
            self.levels.append((high, low, top))

    def near(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the points whose sets could be similar to the query's, ascending."""
        size, nodes = query.sum(), None
        for high, low, top in reversed(self.levels):
            nodes = np.arange(len(high)) if nodes is None else nodes[nodes < len(high)]
            bound = np.minimum(high[nodes], query).sum(1)
            # the overlap of similar sets of sizes a and b is at least percent / (100 + percent) of a + b
            fits = (bound * (100 + percent) >= percent * (size + np.maximum(low[nodes], -(-size * percent // 100)))) & (top[nodes] * 100 >= size * percent) & (low[nodes] * percent <= size * 100)
            nodes = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
        at = self.order[nodes[nodes < len(self.order)]] if nodes is not None else self.order
        bound = np.minimum(self.points[at], query).sum(1)
        return np.sort(at[bound * (100 + percent) >= percent * (size + self.sizes[at])])


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, print (hash of the text), size, digest and node (of 128 and 64 bits; null for an empty set), keys, spare. A task gives the keys of equal sets once."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests, nodes, found, ends, spares = [], [], [], [], [0], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                own, spare = (np.zeros(0, dtype=np.int64), (0, 0)) if digest is None or digest in seen else keys(s, percent)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                sizes.append(len(s))
                digests.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                found.append(own)
                ends.append(ends[-1] + len(own))
                spares += spare
            values = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            pairs = pa.ListArray.from_arrays(pa.array(range(0, 2 * len(sizes) + 1, 2), pa.int32()), pa.array(spares, pa.int32()))
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), lists, pairs]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "size", "digest", "node", "keys", "spare"])

    rows = _numbered(docs)
    return rows.mapInArrow(tidy(measure), "doc_id long, print long, size long, digest binary, node long, keys array<long>, spare array<int>")


def _print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _print(F.col("text")).alias("print"), F.col("text").cast("string").alias("text"))


def _cells(sets: DataFrame) -> DataFrame:
    """Cells with two nodes or more, those with the same nodes once: cell, n (nodes), node, weight (in how many cells, times the others there)."""
    rows = sets.select("node", "spare", F.explode("keys").alias("key"))
    # a key of several nodes, counted before its rows meet, so that a frequent one is no burden
    several = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("often")).where("a <> b").select("key", "often")
    several = written(several, "several")
    met = sifted(rows, F.col("key"), several, F.col("key")).join(several, "key").dropDuplicates(["key", "node"])
    left = F.element_at("spare", (F.col("key").bitwiseAND(1) + 1).cast("int"))
    most = Window.partitionBy("node", F.col("key").bitwiseAND(1)).orderBy(F.desc(F.col("key").bitwiseAND(2)), F.desc("often"), F.desc("key"))
    met = written(met.withColumn("rank", F.row_number().over(most)).where(F.col("rank") > left).select("key", "node"), "met")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("also")).where("n > 1")
    rows = met.join(sizes, "key").select(F.xxhash64("n", "same", "also").alias("cell"), "n", "node")
    out = written(rows.groupBy("cell", "n", "node").agg(F.sum(F.col("n") - 1).alias("weight")), "cells")
    drop(several, met)
    return out


def _searched(cells: DataFrame, labels: DataFrame, content: DataFrame, percent: int, one: int | None = None) -> DataFrame:
    """Pairs (node, other) of classes in a cell and in different components that the trees yield: all of them, or one for each class of a block that isn't in the block's largest component.

    Of a cell with several components, blocks of the classes outside the largest one are each
    a task's with every block of the cell, so that a cell whose classes are mostly connected
    is dealt out about once. With `one`, the number of a round, blocks are each searched alone
    and dealt anew each round.
    """
    own = cells.select("cell", "node").join(labels.select("node", "label", "degree"), "node")
    counts = own.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("cell").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    own = own.join(largest, "cell")
    hashed = F.xxhash64("node", F.lit(1 if one is None else 2 + one))
    if one is None:
        inside = F.col("label") == F.col("most.label")
        rest, big = (F.ceil(x / BLOCK).cast("int") for x in (F.col("all") - F.col("most.c"), F.col("most.c")))
        own = own.select("cell", "node", "label", "degree", inside.alias("inside"), rest.alias("rest"), big.alias("big"))
        own = own.withColumn("block", F.when(F.col("inside"), F.col("rest") + F.pmod(hashed, F.col("big"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int"))
        dealt = own.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(F.col("inside"), 0).otherwise(F.col("big")) - 1)))
    else:
        dealt = own.withColumn("block", F.pmod(hashed, F.ceil(F.col("all") / BLOCK)).cast("int")).withColumn("against", F.col("block"))
    dealt = dealt.select("cell", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"), "block", "node", "label", "degree")
    dealt = dealt.join(content.select("node", "point"), "node")

    def partners(names: np.ndarray, label: np.ndarray, degree: np.ndarray, raw: list) -> tuple[list, list]:
        """One partner for each class outside the largest component: the most connected one that the tree yields, the smaller name of equals."""
        points = together([_unpacked(x) for x in raw])
        tree, x, y = CountTree(points), [], []
        known, often = np.unique(label, return_counts=True)
        largest = known[often.argmax()] if often.max() > 1 else None
        for k in range(len(names)):
            if label[k] != largest:
                near = tree.near(points[k], percent)
                near = near[label[near] != label[k]]
                if len(near):
                    x.append(names[k : k + 1])
                    y.append(names[near[np.lexsort((names[near], -degree[near]))[:1]]])
        return x, y

    def pairs(names: np.ndarray, label: np.ndarray, side: np.ndarray, raw: list, cross: bool) -> tuple[list, list]:
        points = together([_unpacked(x) for x in raw])
        if len(points) == 2:
            a, b = points.sum(1).tolist()
            near = label[0] != label[1] and int(np.minimum(*points).sum()) * (100 + percent) >= percent * (a + b)
            return ([names[1:]], [names[:1]]) if near else ([], [])
        tree, x, y = CountTree(points), [], []
        for k in range(len(names)):
            near = tree.near(points[k], percent)
            near = near[label[near] != label[k]]
            near = near[(side[near] != side[k]) & (near > k)] if cross else near[near > k]
            x.append(names[near])
            y.append(np.full(len(near), names[k]))
        return x, y

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held, out = whole_tasks(rows, last=False)
            yield out
        if held is not None and len(held):
            yield whole_tasks(held, last=True)[1]

    def whole_tasks(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows of the last task, unless it is complete, and the pairs of the others."""
        cell, i, j, names, label, side, degree = (rows[c].to_numpy() for c in ("cell", "i", "j", "node", "label", "block", "degree"))
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        cuts = [0, *ends.tolist(), *([len(rows)] if last else [])]
        raw, xs, ys = rows["point"].to_list(), [], []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                x, y = pairs(names[a:b], label[a:b], side[a:b], raw[a:b], i[a] != j[a]) if one is None else partners(names[a:b], label[a:b], degree[a:b], raw[a:b])
                xs += x
                ys += y
        out = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (xs, ys)]
        return rows.iloc[cuts[-1] :], pd.DataFrame(dict(zip(("node", "other"), out)))

    spread = dealt.repartition(tasks(cells.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return spread.mapInPandas(tidy(scan), "node long, other long").select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()


def _verified(content: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (node, other) whose texts are similar, decided on their shingles. The texts compared with one stream past it, in shares of BLOCK."""
    spark = content.sparkSession
    shares = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("shares"))
    dealt = pairs.join(shares, "other").select("node", "other", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"))
    ones = dealt.select(F.col("other").alias("node"), "other", "share", F.lit(0).alias("kind")).distinct()
    rows = dealt.withColumn("kind", F.lit(1)).unionByName(ones).join(content.select("node", "text"), "node")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, one = None, set()
        for batch in batches:
            nodes, others = [], []
            for other, share, kind, node, text in zip(*(batch.column(c).to_pylist() for c in ("other", "share", "kind", "node", "text")), strict=True):
                if (other, share) != current:
                    current, one = (other, share), set()
                mine = shingles(text, n)
                if kind == 0:
                    one = mine
                    continue
                shared = len(one & mine)
                if 100 * shared >= percent * (len(one) + len(mine) - shared):
                    nodes.append(node)
                    others.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64())], ["node", "other"])

    spread = rows.repartition(tasks(spark), "other", "share").sortWithinPartitions("other", "share", "kind")
    return written(spread.mapInArrow(tidy(compare), "node long, other long"), "links")


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of the nodes of edges (a, b), by large and small stars; links go to written tables, never to the driver."""
    state = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state, before = written(state, "edges"), None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        older, state = state, written(small, "edges")
        drop(older)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the components that links connect became one."""
    a, b = labels.select(F.col("node"), F.col("label").alias("a")), labels.select(F.col("node").alias("other"), F.col("label").alias("b"))
    moves = connected(links.join(a, "node").join(b, "other").select("a", "b")).select(F.col("node").alias("label"), F.col("label").alias("to"))
    out = written(labels.join(moves, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "labels")
    drop(labels, moves)
    return out


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, print, size, kept (missing, doc_id, print of its component's first row by identifier, null ones last; null for an empty set)."""
    sets = written(_sets(docs, n, percent), "sets")
    members = written(sets.select("doc_id", "print", "size", "digest", "node"), "members")
    cells = _cells(sets.where(F.size("keys") > 0))
    drop(sets)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "print")).alias("first")
    # classes that share a cell; from here on a class has a number of its own, as two digests could agree in 64 bits
    degrees = cells.groupBy("node").agg(F.sum("weight").alias("degree"))
    classes = members.where("size > 0").join(degrees, "node").groupBy("digest").agg(F.first("node").alias("hash"), F.first("size").alias("size"), F.first("degree").alias("degree"), first)
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    cells = cells.select("cell", F.col("node").alias("hash")).join(classes.select("hash", "node"), "hash").select("cell", "node")

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [_packed(point(s)) for s in shingle_sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(points, pa.binary()), batch.column("text")], ["node", "point", "text"])

    wanted = classes.select("node", F.col("first.doc_id").alias("id"), F.col("first.print").alias("mark"))
    texts = sifted(_numbered(docs), F.col("print"), wanted, F.col("mark")).groupBy("doc_id", "print").agg(F.first("text").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("mark"))).select("node", "text")
    content = written(texts.mapInArrow(tidy(placed), "node long, point binary, text string"), "content")

    labels = written(classes.select("node", F.col("node").alias("label"), "degree", "size"), "labels")
    cells, tested, links = written(cells, "cells"), None, None
    for k in range(ROUNDS + 1):
        pairs = _searched(cells, labels, content, percent, k if k < ROUNDS else None)
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("other").alias("node"), F.col("node").alias("other")))
            pairs = pairs.join(known, ["node", "other"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            drop(pairs)
            if k < ROUNDS:
                continue
            break
        links = _verified(content, pairs, n, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not links.isEmpty():
            labels = _relabelled(labels, links)
        drop(links)
    drop(content, cells, *([tested] if tested is not None else []))
    joined = classes.select("node", "digest", "first").join(labels.select("node", "label"), "node")
    kept = joined.groupBy("label").agg(F.min("first").alias("kept"))
    kept = joined.join(kept, "label").select("digest", "kept")
    alone = members.where("size > 0").groupBy("digest").agg(first)
    kept = alone.join(kept, "digest", "left").select("digest", F.coalesce("kept", "first").alias("kept"))
    return members.join(kept, "digest", "left").select("doc_id", "print", "size", "kept")


def near_duplicates(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable by links, itself included.

    Two documents link when their sets of n-word shingles are equal and not empty, or have a Jaccard
    similarity of percent / 100 or more. Documents without words, null and empty texts among them, link
    with none: their component is their own identifier. Null identifiers are never the smallest; a
    component without others has a null one. Rows that share a doc_id but not a text are documents of
    their own. Texts may be of any length that a row of a task can hold. Further columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    found = _components(docs, n, percent)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("kept.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest identifier, null ones last.

    Decided by row, that is identifier and text: rows that share an identifier but not a text are
    documents of their own, and of rows that repeat both one stays. Rows without words all stay.
    All columns stay, whatever their names.
    """
    found = written(_components(docs, n, percent).where("size > 0"), "found")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("print") == F.col("kept.print"))
    # rows to decide on: those that go, and those that stay once of several
    marks = found.groupBy("doc_id", "print").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("often")).where("not stays or often > 1")
    taken = [*docs.columns]
    print_, hit, id_, mark, left = (fresh(c, taken) for c in ("__print", "__hit", "__id", "__mark", "__stays"))
    marks = written(marks.select(F.col("doc_id").alias(id_), F.col("print").alias(mark), F.col("stays").alias(left)), "marks")
    drop(found)
    rows = docs.withColumn(print_, _print(F.col("text")))
    rows = marked(rows, F.col(print_), marks, F.col(mark), hit)
    free, tried = rows.where(~F.col(hit)), rows.where(F.col(hit))
    tried = tried.join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(print_) == F.col(mark)), "left")
    once = tried.where(F.col(left)).dropDuplicates([id_, mark])
    plain = [f"`{c}`" for c in docs.columns]
    return free.select(*plain).unionAll(tried.where(F.col(left).isNull()).select(*plain)).unionAll(once.select(*plain))


#: The same components by joining all shingles; a component of many documents makes this slow on large tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT r.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY 1
"""
