"""Benchmark decontamination by containment (operator 7), in DataFrame operations only.

A test item is contained in a document when the document has at least `share` of the
item's distinct word shingles. Items are partitioned by size, the number of their
shingles, in powers of two. The MinHash sketch of an item is its least-hashed
shingles, of a depth set by the largest size of its partition: a document that holds
`share` of the item lacks at most the rest, so it holds at least depth - rest of the
sketch. Documents are searched for sketch hashes, which is complete for that reason,
and the pairs found are verified by exact containment of the shingles' words.

An item of fewer words than a shingle has one shingle, all its words in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import fresh, words_sql, written


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; an empty array for fewer."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, n: int) -> Column:
    """The distinct runs of n words, joined by spaces."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<string>")))


def _joined(arrays: list[Column], kind: str) -> Column:
    """Arrays of shingles of several lengths, one after the other."""
    return F.concat(*arrays) if arrays else F.array().cast(f"array<{kind}>")


def item_sketches(items: DataFrame, n: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(sketches, shingles): a row for each item and hash of its sketch (hash, item_id, item, needed: hashes that a document must hold); a row an item (item_id, item, length, size, shingles).

    item is a number for each distinct text of an item_id, length the number of words of its shingles: n, or all its words if they are fewer. Items without words are in neither.
    """
    key = F.xxhash64("item_id", "text")
    # words are a column of their own: as an expression within a lambda they would be made again for each shingle.
    # For the same reason explode_outer below: for explode the optimizer adds a filter on the array, and moves words into it.
    worded = items.select("item_id", key.alias("item"), words_sql().alias("words"))
    shingles = F.when(F.size("words") < n, F.array(F.array_join("words", " "))).otherwise(shingle_texts(F.col("words"), n))
    some = worded.where(F.size("words") > 0).select("item_id", "item", F.least(F.size("words"), F.lit(n)).alias("length"), shingles.alias("shingles"))
    whole = some.dropDuplicates(["item_id", "item"])
    whole = written(whole.withColumn("size", F.size("shingles")), "items")
    lack = lambda size: F.floor(size * F.lit(1 - share) + F.lit(1e-6)).cast("int")
    largest = F.pow(F.lit(2.0), F.floor(F.log2("size")) + 1) - 1
    # twice as many as could lack, so that a passage shared with other texts seldom suffices
    depth = F.least(F.col("size"), 2 * lack(largest) + 2).cast("int")
    rows = whole.select("item_id", "item", "size", depth.alias("depth"), F.explode("shingles").alias("shingle"))
    # hashed as in documents, word for word; words that a short item lacks are null, which a hash leaves out
    words = F.split("shingle", " ")
    rows = rows.select("item_id", "item", "size", "depth", F.xxhash64(*(F.get(words, F.lit(k)) for k in range(n))).alias("hash"))
    rank = F.row_number().over(Window.partitionBy("item_id", "item").orderBy("hash"))  # an item is short
    sketches = rows.withColumn("rank", rank).where(F.col("rank") <= F.col("depth")).select("hash", "item_id", "item", (F.col("depth") - lack(F.col("size"))).alias("needed"))
    return written(sketches, "sketches"), whole


def containments(docs: DataFrame, items: DataFrame, *, n: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs of a document (doc_id, text) and an item (item_id, text) that it contains: doc_id, print (hash of the text), item_id, n_shingles (of the item), n_shared, containment.

    Words are maximal runs of characters outside space and tab to carriage return, A-Z lower-cased;
    shingles are n words. An item of fewer words is one shingle, contained in each document that has all
    its words in a row. Texts without words, null and empty ones contain nothing and are contained in nothing. Rows of a document that are repeated give one row; rows that share a doc_id but not a
    text are held apart by print; null identifiers are kept. Texts of any length are read whole, as one
    row of a task each. Further columns are ignored; empty tables give an empty result.
    """
    sketches, whole = item_sketches(items, n, share)
    own = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    lengths = sorted(r.length for r in whole.select("length").distinct().collect())  # n numbers at most
    worded = own.select("doc_id", "print", words_sql().alias("words"))
    hashes = _joined([shingle_hashes(F.col("words"), m) for m in lengths], "bigint")
    hashed = worded.select("doc_id", "print", F.explode_outer(hashes).alias("hash"))
    # Spark broadcasts the sketches if the size of the table written is below its limit
    met = hashed.join(sketches, "hash").groupBy("doc_id", "print", "item_id", "item").agg(F.countDistinct("hash").alias("met"), F.first("needed").alias("needed"))
    pairs = written(met.where("met >= needed").select("doc_id", "print", "item_id", "item"), "candidates")
    d, p = own.alias("d"), pairs.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.print") == F.col("p.print"))
    keys = pairs.select("doc_id", "print").distinct().alias("p")
    found = d.join(keys, same, "left_semi").select("d.*").dropDuplicates(["doc_id", "print"])
    texts = _joined([shingle_texts(F.col("words"), m) for m in lengths], "string")
    shingled = found.select("doc_id", "print", words_sql().alias("words")).select("doc_id", "print", texts.alias("own")).alias("d")
    verified = shingled.join(p, same).join(whole.alias("w"), F.col("p.item_id").eqNullSafe(F.col("w.item_id")) & (F.col("p.item") == F.col("w.item")))
    shared = F.size(F.array_intersect("own", "shingles"))
    rows = verified.select("d.doc_id", "d.print", "w.item_id", F.col("size").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return rows.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.col("n_shingles") * share - 1e-9)


def op7_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    found = containments(docs, items)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("m")).select("doc_id", "item_id", "m.n_shingles", "m.n_shared", F.round("m.containment", 9).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all their columns, whatever their names."""
    id_, print_ = fresh("__id", docs.columns), fresh("__print", docs.columns)
    found = written(containments(docs, items).select(F.col("doc_id").alias(id_), F.col("print").alias(print_)).distinct(), "found")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(print_)), "left_anti")


#: The same pairs from all shingles of all texts.
ORACLE = r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM folded
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS m FROM words WHERE kind = 'i' AND len(w) > 0
), places AS (
  SELECT kind, id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, lengths WHERE len(w) >= m AND (kind = 'd' OR m = least(len(w), 5))
), shingles AS (
  SELECT DISTINCT kind, id, concat_ws(' ', w[i], CASE WHEN m > 1 THEN w[i + 1] END, CASE WHEN m > 2 THEN w[i + 2] END, CASE WHEN m > 3 THEN w[i + 3] END, CASE WHEN m > 4 THEN w[i + 4] END) AS s FROM places
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, sizes.n AS n_shingles, shared.n AS n_shared, round(shared.n / sizes.n, 9) AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE shared.n >= sizes.n * 0.8 - 1e-9
"""
