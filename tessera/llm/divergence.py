"""Divergence of sources by their smoothed word shares, in tiles of group blocks (operator 11).

A group is a source within a language. Its share of a kept term is an integer, a floor of an
exact quotient, made in decimal arithmetic. The kept terms of a language are dealt into
chunks of some thousand, and the counts that a group has in a chunk are packed into one row.
Groups are dealt into blocks; a packed row goes to every tile (block by block) of its block,
and a tile's task walks over successive chunks of the vocabulary, adding each chunk's
differences to its pair submatrix. It holds two blocks of groups and one chunk at a time.
Long vocabularies are cut into spans of chunks, whose submatrices are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import tasks, tidy, written

#: Terms of a chunk, chunks of a span, groups of a block.
CHUNK, SPAN, BLOCK = 4096, 32, 64
#: Different terms that a counting task holds before it passes its counts on.
HELD = 300_000

#: Bytes of UTF-8 outside terms become spaces, A-Z are lower-cased; all bytes of further characters stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters A-Z and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (documents of the group with the term). Counts are gathered in each task, so a term of every document is a few rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> pa.RecordBatch:
            rows = [(lang, source, t, n, found[t]) for (lang, source), (often, found) in held.items() for t, n in often.items()]
            held.clear()
            lang, source, term, often, found = zip(*rows) if rows else ([],) * 5
            arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(often, pa.int64()), pa.array(found, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                own = terms(text.as_py())
                often, found = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                often.update(own)
                found.update(set(own))
            if sum(len(often) for often, _ in held.values()) > HELD:
                yield passed()
        yield passed()

    counted = _plain(docs).mapInArrow(tidy(count), "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _share(count: str, n: str, v: str) -> str:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), exact: the products are decimals of 38 digits."""
    return f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) div cast({n} + 5 * {v} as decimal(21,0))"


class Shares:
    """The tables that both parts read, written once: groups (lang, source, n, v, base: the share of a term that it lacks), kept (lang, term, total, chunk, slot, q) and cells (lang, source, term, chunk, slot, p, q)."""

    def __init__(self, docs: DataFrame, least: int):
        counts = written(term_counts(docs), "counts")
        totals = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        kept = written(totals.select("lang", "term", "total"), "kept")
        # a row a language, written so that Spark knows its size and broadcasts it while it is small
        langs = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "langs")
        kept = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
        # a chunk has about CHUNK terms, so the window is bounded
        kept = kept.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
        self.kept = written(kept.select("lang", "term", "chunk", "slot", F.expr(_share("total", "`all`", "v")).alias("q")), "terms")
        met = written(counts.join(self.kept, ["lang", "term"]).select("lang", "source", "term", "count", "chunk", "slot", "q"), "met")
        sums = met.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = _plain(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        self.groups = written(groups.withColumn("base", F.when(F.col("v") > 0, F.expr(_share("0", "n", "v"))).otherwise(0)), "groups")
        self.cells = met.join(self.groups.select("lang", "source", "n", "v"), ["lang", "source"]).select("lang", "source", "term", "chunk", "slot", F.expr(_share("count", "n", "v")).alias("p"), "q")


def typical(s: Shares, most: int) -> DataFrame:
    """Each group's `most` terms whose share is farthest above the language's: lang, source, item, value, rank."""
    over = s.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", rank).where(F.col("rank") <= most)  # Spark keeps `most` rows a group before it shuffles


def distances(s: Shares) -> DataFrame:
    """lang, source, item, value: for each two groups of a language, in both directions, the sum of the differences of their shares over all kept terms."""
    sizes = written(s.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    groups = s.groups.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).select("lang", "source", "block", "blocks", "base")
    spans = s.kept.groupBy("lang", F.floor(F.col("chunk") / SPAN).cast("int").alias("span")).agg(F.count(F.lit(1)).cast("int").alias("width"))
    heads = groups.join(spans, "lang", "left").select("lang", F.coalesce("span", F.lit(0)).alias("span"), "source", "block", "blocks", F.lit(-1).alias("chunk"), F.col("base").alias("base"), F.coalesce("width", F.lit(0)).alias("width"), F.array().cast("array<int>").alias("slots"), F.array().cast("array<int>").alias("shares"))
    lists = s.cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("p").cast("int").alias("p"))).alias("x"))
    packed = lists.join(groups, ["lang", "source"]).select("lang", F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "source", "block", "blocks", "chunk", F.lit(0).cast("long").alias("base"), F.lit(0).alias("width"), F.col("x.slot").alias("slots"), F.col("x.p").alias("shares"))
    dealt = heads.unionByName(packed).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "against"), "j": F.greatest("block", "against")}).drop("against", "blocks")
    spread = dealt.repartition(tasks(dealt.sparkSession), "lang", "span", "i", "j").sortWithinPartitions("lang", "span", "i", "j", "chunk")
    pairs = spread.mapInArrow(tidy(_tiles), "lang string, source string, item string, value long")
    return pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


class _Tile:
    """The pair submatrix of two blocks of groups, or of one with itself."""

    def __init__(self, same: bool):
        self.same, self.rows, self.width, self.seen = same, {}, 0, 0
        self.base: list[int] = []
        self.block: list[int] = []
        self.chunk: int | None = None
        self.held: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.sums: np.ndarray | None = None

    def head(self, source: str, block: int, base: int, width: int) -> None:
        self.rows[source] = len(self.rows)
        self.base.append(base)
        self.block.append(block)
        self.width = width

    def row(self, source: str, chunk: int, slots: np.ndarray, shares: np.ndarray) -> None:
        if chunk != self.chunk:
            self.add()
            self.chunk = chunk
        self.held.append((self.rows[source], slots, shares))

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        block = np.array(self.block)
        return (np.arange(len(block)),) * 2 if self.same else (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min()))

    def add(self) -> None:
        """Adds the differences of the chunk that is held, over the terms that any group of the tile has."""
        if not self.held:
            return
        slots = np.unique(np.concatenate([s for _, s, _ in self.held]))
        dense = np.repeat(np.array(self.base, dtype=np.int64)[:, None], len(slots), axis=1)
        for at, own, shares in self.held:
            dense[at, np.searchsorted(slots, own)] = shares
        self.held, self.seen = [], self.seen + len(slots)
        a, b = self._sides()
        part = np.stack([np.abs(dense[b] - dense[x]).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)), dtype=np.int64)
        self.sums = part if self.sums is None else self.sums + part

    def pairs(self) -> tuple[list[str], list[str], list[int]]:
        self.add()
        a, b = self._sides()
        base = np.array(self.base, dtype=np.int64)
        # terms of the span that none of these groups has
        total = np.abs(base[a][:, None] - base[b][None, :]) * (self.width - self.seen) + (0 if self.sums is None else self.sums)
        names, x, y, values = list(self.rows), [], [], []
        for r, p in enumerate(a):
            for c, q in enumerate(b):
                if p != q:
                    x.append(names[p])
                    y.append(names[q])
                    values.append(int(total[r, c]))
        return (x, y, values) if self.same else (x + y, y + x, values * 2)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, tile = None, None

    def out(lang: str, found: tuple[list[str], list[str], list[int]]) -> pa.RecordBatch:
        x, y, values = found
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("lang", "span", "i", "j", "source", "block", "chunk", "base", "width")]
        slots, shares = batch.column("slots"), batch.column("shares")
        for k, (lang, span, i, j, source, block, chunk, base, width) in enumerate(zip(*keys, strict=True)):
            if (lang, span, i, j) != current:
                if tile is not None:
                    yield out(current[0], tile.pairs())
                current, tile = (lang, span, i, j), _Tile(i == j)
            if chunk < 0:
                tile.head(source, block, base, width)
            else:
                tile.row(source, chunk, slots[k].values.to_numpy(), shares[k].values.to_numpy())
    if tile is not None:
        yield out(current[0], tile.pairs())


def audit(docs: DataFrame, *, least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others (`pair`) and the terms it uses more than the language does (`term`, the first `most`).

    Terms are kept that at least `least` documents of the language have. Null lang, source and text count
    as ''; texts without terms make a group all the same; a language without kept terms has distances of 0.
    Ties rank by item in UTF-8; repeated rows count again. Texts may be of any length that a row can hold.
    Further columns are ignored, whatever their names; an empty table gives an empty result.
    """
    s = Shares(docs, least)
    pairs = distances(s).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", typical(s, most)))]
    return parts[0].unionByName(parts[1])


def op11_divergence(docs: DataFrame) -> DataFrame:
    return audit(docs)


_P = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * l.v)"
#: The same from every group with every kept term of its language.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY 1
), used AS (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), groups AS (
  SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, coalesce(sum(c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY 1, 2
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, {_P.format("coalesce(c, 0)", "n")} AS p, {_P.format("k.total", "l.total")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cells x ON x.lang = a.lang AND x.source = a.source LEFT JOIN cells y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM cells WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 50
"""
