"""Merkle manifest of a dataset, collapsed with higher-order functions (operator 12).

A row is a leaf, a source a tree of its leaves in order of their identifiers, and the
roots of the sources, in order of their names, are the leaves of one more tree. While
several nodes remain, every FAN consecutive ones become the digest of their concatenation.

Nodes are dealt into blocks of FAN ** LEVELS consecutive ones, so a block is an array of
fixed size that collapses on its own: aggregate() over its levels, transform() over the
runs of a level, slice() for the nodes of a run. The roots of the blocks are the nodes of
the next round, until a block holds a whole tree. Proofs come back the other way: a block
appends the siblings above it to those within it, so only the paths of blocks, not of
leaves, are ever shuffled.

Places come from ranges of (tree, order), written once: a source that holds most rows is
dealt out like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop, tasks, written

#: Nodes of a run, and the levels that a block collapses: blocks of 729 nodes.
FAN, LEVELS = 3, 6
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes, or of bytes."""
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row whose text is the given column: doc_id, source, lang, n_chars and text, each `-` if null, else its length in bytes, a colon and its value."""
    return digest(F.concat(_field(F.col("doc_id").cast("long")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars").cast("long")), _field(text)))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at, the place from 0 within `tree` in ascending `order` (nulls first), and n, the rows of the tree. Ranges of (tree, order) are written once and counted; no task has more than a range."""
    kept = written(rows.repartitionByRange(tasks(rows.sparkSession), "tree", *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = kept.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"))  # a row a range and a tree in it
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("tree", "part", before.alias("before"), F.sum("m").over(own).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = kept.withColumn("place", place).join(offsets, ["tree", "part"]).withColumn("at", F.col("before") + F.col("place") - 1)
    out = written(placed.select(*rows.columns, F.col("at").cast("long"), F.col("n").cast("long")), "numbered")
    drop(kept)
    return out


def _levels(digests: Column, depth: Column) -> Column:
    """The digests, and the nodes of each of `depth` levels above them: an array of arrays."""

    def above(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FAN).cast("int"))
        return F.concat(found, F.array(F.transform(runs, lambda i: digest(F.array_join(F.slice(last, i * FAN + 1, FAN), "")))))

    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(digests), above)


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """A row a block: tree, block, n (nodes of the tree), held (structs of place, digest and payload, in order), levels."""
    wide = FAN**LEVELS
    held = F.sort_array(F.collect_list(F.struct("at", "digest", *payload)))  # `wide` nodes at most
    rows = nodes.groupBy("tree", F.floor(F.col("at") / wide).alias("block")).agg(F.first("n").alias("n"), held.alias("held"))
    depth = F.size(F.filter(F.array(*(F.lit(FAN**d).cast("long") for d in range(LEVELS))), lambda p: p < F.col("n")))
    return rows.withColumn("levels", _levels(F.transform("held", lambda x: x["digest"]), depth))


@dataclass
class Forest:
    """Trees that share a numbering. rounds: tables of blocks, leaves first; tops: a row a tree (tree, digest, n: its leaves)."""

    rounds: list[DataFrame] = field(default_factory=list)
    tops: DataFrame | None = None

    def drop(self) -> None:
        drop(*self.rounds, self.tops)


def forest(nodes: DataFrame, payload: list[str]) -> Forest:
    """Collapses numbered nodes (tree, at, n, digest and payload) to the roots of their trees, round by round."""
    out, tops, sizes = Forest(), None, nodes.groupBy("tree").agg(F.first("n").alias("leaves"))
    while True:
        blocks = written(_blocks(nodes, payload if not out.rounds else []), "blocks")
        out.rounds.append(blocks)
        roots = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        done = roots.where("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        nodes = roots.where("n > 1")
        if nodes.isEmpty():
            out.tops = written(tops.join(sizes, "tree").select("tree", "digest", F.col("leaves").alias("n")), "tops")
            return out


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of blocks (tree, place, node: the struct held, path: its siblings up to the root, top), given the paths of the blocks (tree, at, path, top)."""
    wide = FAN**LEVELS

    def siblings(x: Column) -> Column:
        def step(level: Column, up: Column) -> Column:
            at = F.floor((x["at"] % wide) / F.pow(F.lit(FAN), up)).cast("int")
            own = at % FAN
            left, right = F.slice(level, at - own + 1, own), F.slice(level, at + 2, F.lit(FAN - 1) - own)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        return F.concat(F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), step).cast(_PATH), F.col("path"))

    joined = blocks.join(above.select("tree", F.col("at").alias("block"), "path", "top"), ["tree", "block"])
    nodes = F.transform("held", lambda x: F.struct(x.alias("node"), siblings(x).alias("path")))
    return joined.select("tree", "top", nodes.alias("nodes"))


def paths(trees: Forest, above: DataFrame) -> DataFrame:
    """A row a block of leaves: tree, top, nodes (structs of node and path). above: tree, path (siblings beyond the tree's root) and top, which is carried along."""
    starts = above.withColumn("at", F.lit(0).cast("long"))
    known = starts
    for k in range(len(trees.rounds) - 1, 0, -1):
        # trees that end in a lower round have no block here and keep their own start
        found = _with_paths(trees.rounds[k], known).select("tree", "top", F.explode("nodes").alias("x"))
        below = found.select("tree", F.col("x.node.at").alias("at"), F.col("x.path").alias("path"), "top")
        known = below.unionByName(starts.join(trees.rounds[k].select("tree").distinct(), "tree", "left_anti").select("tree", "at", "path", "top"))
    return _with_paths(trees.rounds[0], known)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


@dataclass
class Manifest:
    """What is published of a dataset: sources (source, n: its leaves, digest: its root), root, and the trees themselves for proofs."""

    sources: DataFrame
    root: str | None
    leaves: Forest
    names: Forest


def _tree(source: Column) -> Column:
    """A text for each source, null first in its order."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The Merkle manifest of docs (doc_id, source, lang, n_chars, text).

    Within a source leaves ascend by doc_id, null ones first, rows that share one by their leaf; equal
    rows are leaves of their own. Null values have a leaf digest of their own (see leaf_digest) and null
    sources are one source, the first. Texts of any length that a row can hold are hashed whole. Further
    columns are ignored, whatever their names. An empty table has no sources and no root. `tampered`, a
    text, is hashed beside the true one for what proofs() verifies.
    """
    changed = leaf_digest(tampered) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"), changed.alias("claim"), F.monotonically_increasing_id().alias("row"))
    # row only tells equal rows apart, so that ranges can part them
    nodes = numbered(rows, ["doc_id", "digest", "row"])
    leaves = forest(nodes, ["doc_id", "claim"])
    drop(nodes)
    names = numbered(leaves.tops.select(F.lit("sources").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top = forest(names, ["name"])
    drop(names)
    root = top.tops.first()
    source = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return Manifest(leaves.tops.select(source.alias("source"), "n", "digest"), root and root.digest, leaves, top)


def proofs(m: Manifest) -> DataFrame:
    """A row a leaf: doc_id, leaf, subroot, root, path (structs of the texts left and right of the node, level by level up to the root), claim (the leaf to verify: of the tampered text, if there is one), folded_root, verified."""
    start = m.names.tops.select("tree", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("top"))
    found = paths(m.names, start).select(F.explode("nodes").alias("x"))
    above = written(found.select(F.col("x.node.name").alias("tree"), F.col("x.path").alias("path"), F.col("x.node.digest").alias("top")), "above")
    claim = lambda x: F.coalesce(x["node"]["claim"], x["node"]["digest"])
    nodes = F.transform("nodes", lambda x: F.struct(x["node"]["doc_id"].alias("doc_id"), x["node"]["digest"].alias("leaf"), x["path"].alias("path"), claim(x).alias("claim"), folded(claim(x), x["path"]).alias("folded_root")))
    rows = paths(m.leaves, above).select("top", F.explode(nodes).alias("x"))
    out = rows.select("x.doc_id", "x.leaf", F.col("top").alias("subroot"), F.lit(m.root).cast("string").alias("root"), "x.path", "x.claim", "x.folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256 (digest of its siblings), folded_root (from the text without newlines where 2 divides the identifier's crc32), verified."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    found = proofs(manifest(docs, F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("(doc_id::VARCHAR)", "source", "lang", "(n_chars::VARCHAR)", "{text}")) + ")"
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"

#: Trees by recursion over levels, each one group by, and the path of every leaf by recursion upwards.
ORACLE = f"""
WITH RECURSIVE claims AS (
  SELECT *, coalesce('=' || source, '') AS tree, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents
), leaves AS (
  SELECT tree, doc_id, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="claimed")} AS claim FROM claims
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes(tree, lev, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, any_value(lev) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 3
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(lev, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroots
  UNION ALL
  SELECT any_value(lev) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 3
), every AS (
  SELECT tree, lev, pos, digest FROM nodes UNION ALL SELECT NULL, lev, pos, digest FROM upper
), runs AS (
  SELECT tree, lev, pos // 3 AS run, list(digest ORDER BY pos) AS held FROM every GROUP BY ALL
), climb(doc_id, leaf, tree, high, lev, pos, n, node, siblings) AS (
  SELECT doc_id, leaf, tree, FALSE, 0, pos, n, claim, '' FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.high OR c.n = 1,
    CASE WHEN c.n = 1 THEN 0 ELSE c.lev + 1 END,
    CASE WHEN c.n = 1 THEN s.pos ELSE c.pos // 3 END,
    CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 2) // 3 END,
    CASE WHEN c.n = 1 THEN c.node ELSE sha256(array_to_string(r.held[:c.pos % 3] || [c.node] || r.held[c.pos % 3 + 2:], '')) END,
    CASE WHEN c.n = 1 THEN c.siblings ELSE c.siblings || array_to_string(r.held[:c.pos % 3] || r.held[c.pos % 3 + 2:], '') END
  FROM climb c
  LEFT JOIN subroots s ON s.tree = c.tree
  LEFT JOIN runs r ON c.n > 1 AND r.lev = c.lev AND r.run = c.pos // 3 AND r.tree IS NOT DISTINCT FROM (CASE WHEN c.high THEN NULL ELSE c.tree END)
  WHERE NOT (c.high AND c.n = 1)
)
SELECT c.doc_id, c.leaf, s.digest AS subroot, u.digest AS root, sha256(c.siblings) AS proof_sha256, c.node AS folded_root, c.node = u.digest AS verified
FROM climb c JOIN subroots s ON s.tree = c.tree JOIN upper u ON u.n = 1 WHERE c.high AND c.n = 1
"""
