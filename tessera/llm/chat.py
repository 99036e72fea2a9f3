"""Chat formatting as prefix trees (operator 1).

A conversation becomes a chain of segments, one a turn. Conversations that share
initial turns share their nodes in a prefix tree, and the tokens of a node are
emitted once, the nodes of a tree depth-first. A node has the index of its first
token in its tree, the position id of that token (tokens of its ancestors), and the
intervals of the tree's tokens that are its ancestors', adjoining ones merged; a
token attends to those and to the tokens of its own node up to itself.

Depth-first order is the order of the paths, a path being the digests of the turns
in a row: paths are range-partitioned and sorted, and a path's new nodes are those
beyond the prefix that it shares with the path before it. What crosses from one
partition to the next is one path, which the driver carries on.

A segment is `<turn>### role: text</turn>` and a line feed. In texts a backslash
goes before backslashes, `<turn`, `</turn` and `###`; in roles before each
backslash, colon, `<` and `#`. Header, text and end are encoded apart, so that the
loss mask, the text of assistant turns, falls on token borders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tasks, tidy, written
from tessera.llm.sstable import tokenizer_path
from tessera.llm.tokens import encoder

TRAINED_ROLE = "assistant"
END = "</turn>\n"
_SEGMENT = re.compile(r"<turn>### ((?:[^\\:<#]|\\.)*+): ((?:[^\\<]+|\\.|<(?!/?turn))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"\\|</?turn|###", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|</?turn|###)", r"\1", text)


def header(role: str) -> str:
    return "<turn>### " + re.sub(r"[\\:<#]", r"\\\g<0>", role) + ": "


def segment(role: str, text: str) -> str:
    return header(role) + escape(text) + END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    at, turns = 0, []
    while at < len(formatted):
        found = _SEGMENT.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((re.sub(r"\\(.)", r"\1", found[1], flags=re.DOTALL), unescape(found[2])))
        at = found.end()
    return turns


def _shared(a: list, b: list) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


class Forest:
    """A depth-first walk over sorted paths. stack: (digest, start, length) of the nodes of the path before, starts counted over the whole forest."""

    def __init__(self, offset: int = 0, stack: Iterable[tuple[str, int, int]] = ()):
        self.offset, self.stack = offset, list(stack)

    def step(self, digests: list[str], lengths: list[int]) -> int:
        """Moves on to the next path; returns how many of its nodes are not new."""
        known = _shared([s[0] for s in self.stack], digests)
        del self.stack[known:]
        for digest, length in zip(digests[known:], lengths[known:], strict=True):
            self.stack.append((digest, self.offset, length))
            self.offset += length
        return known


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for span in spans:
        _extend(out, span)
    return out


def _extend(out: list[tuple[int, int]], span: tuple[int, int]) -> None:
    """Adds an interval behind the others, merged with the last if they adjoin."""
    a, b = span
    if a < b:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append(span)


def _slices(batches: Iterable[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches in parts, since nested lists of a whole one take much memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def _split(path: str) -> list[str]:
    return [path[i : i + 32] for i in range(0, len(path), 32)]


def prefix_trees(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges conversations (conv_id, turn, role, text) into prefix trees: (nodes, paths, members).

    nodes: tree (digest of its first turn), start (index of the first token in the tree), position
    (position id of the first token), n_tokens, ids (little-endian unsigned 32-bit integers), attends
    (the ancestors' intervals), loss_from and loss_to (tokens of the node under the loss mask), role,
    text (the formatted segment), text_loss_from, text_loss_to (code points of it under the mask).
    paths: key (128 bits of the path, as hexadecimal digits), path (the digests of its turns), tree, starts
    (of its nodes), attends, one row for each distinct conversation.
    members: conv_id, key.

    Turns go by turn, ties by role and text; a null turn comes first, a null role or text is empty.
    Rows with a null conv_id are one conversation. Repeated rows are repeated turns. Further columns
    are ignored; an empty table gives empty results. One conversation must fit into a task's memory,
    which takes a multiple of its text and of the number of its turns.
    """
    path_of = tokenizer or tokenizer_path()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    digest = F.array_join(F.transform("turns", lambda t: F.md5(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text).cast("binary"))), "")
    talks = written(talks.select("conv_id", digest.alias("path"), F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")), "talks")
    members = talks.select("conv_id", F.md5("path").alias("key"))

    def formatted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path_of)
        for batch in _slices(batches):
            ids = [[[coder.packed(header(t["role"])), coder.packed(escape(t["text"])), coder.packed(END)] for t in turns] for turns in batch["turns"]]
            lengths = [[sum(map(len, parts)) // 4 for parts in one] for one in ids]
            yield pd.DataFrame({"path": batch["path"], "lengths": lengths, "ids": ids, "turns": batch["turns"]})

    distinct = talks.groupBy("path").agg(F.first("turns").alias("turns"))
    distinct = written(distinct.mapInPandas(tidy(formatted), "path string, lengths array<int>, ids array<array<binary>>, turns array<struct<role:string,text:string>>"), "paths")

    # borders of the partitions, from a bounded number of paths
    n = tasks(conversations.sparkSession)
    # (the first turns of each, as a border need not be a whole path)
    drawn = sorted(r.path for r in distinct.select(F.substring("path", 1, 32 * 16).alias("path")).orderBy(F.xxhash64("path")).limit(20 * n).collect())
    borders = drawn[20::20]
    part = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= F.col("path"))) if borders else F.lit(0)

    def by_part(columns: list[str]) -> DataFrame:
        return distinct.select(part.alias("p"), *columns).repartition(n, "p").sortWithinPartitions("p", "path")

    def survey(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walk, first = None, Forest(), []
        done = lambda: pd.DataFrame([(current, first, walk.offset, [s[0] for s in walk.stack], [s[1] for s in walk.stack], [s[2] for s in walk.stack])], columns=["p", "first", "total", "digests", "starts", "lengths"])
        for batch in batches:
            for p, path, lengths in zip(batch["p"], batch["path"], batch["lengths"], strict=True):
                if p != current:
                    if current is not None:
                        yield done()
                    current, walk, first = p, Forest(), _split(path)
                walk.step(_split(path), list(lengths))
        if current is not None:
            yield done()

    begin: dict[int, tuple[int, list]] = {}
    carried = Forest()
    for r in by_part(["path", "lengths"]).mapInPandas(tidy(survey), "p int, first array<string>, total long, digests array<string>, starts array<long>, lengths array<long>").orderBy("p").toLocalIterator():
        begin[r.p] = (carried.offset, list(carried.stack))
        known = _shared([s[0] for s in carried.stack], r.first)
        saved = sum(s[2] for s in carried.stack[:known])
        kept = min(known, _shared(r.first, r.digests))
        later = [(d, s - saved + carried.offset, k) for d, s, k in list(zip(r.digests, r.starts, r.lengths, strict=True))[kept:]]
        carried = Forest(carried.offset + r.total - saved, [*carried.stack[:kept], *later])

    span = "array<struct<start:long,end:long>>"
    node = "tree string, start long, position long, n_tokens long, ids binary, loss_from long, loss_to long, role string, text string, text_loss_from long, text_loss_to long"

    def emit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walk = None, Forest()
        for batch in _slices(batches):
            rows = []
            for p, path, lengths, ids, turns in zip(batch["p"], batch["path"], batch["lengths"], batch["ids"], batch["turns"], strict=True):
                if p != current:
                    current, walk = p, Forest(*begin[p])
                known = walk.step(_split(path), list(lengths))
                tree, root = walk.stack[0][0], walk.stack[0][1]
                position, attends, starts = 0, [], []
                for i, (_, at, length) in enumerate(walk.stack):
                    at -= root
                    if i >= known:
                        head, body, tail = map(bytes, ids[i])
                        role, text = turns[i]["role"], turns[i]["text"]
                        own, start = segment(role, text), len(header(role))
                        trained = role == TRAINED_ROLE
                        rows.append((None, tree, at, position, length, head + body + tail, len(head) // 4, (len(head) + trained * len(body)) // 4, role, own, start, len(own) - len(END) if trained else start, list(attends), None))
                        if len(rows) >= 500:
                            yield formed(rows)
                            rows = []
                    starts.append(at)
                    _extend(attends, (at, at + length))
                    position += length
                rows.append((path, tree, None, None, None, None, None, None, None, None, None, None, attends, starts))
            yield formed(rows)

    def formed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", *(x.split()[0] for x in node.split(", ")), "attends", "starts"])
        return out.astype({c: "Int64" for c in ("start", "position", "n_tokens", "loss_from", "loss_to", "text_loss_from", "text_loss_to")})

    out = written(by_part(["path", "lengths", "ids", "turns"]).mapInPandas(tidy(emit), f"path string, {node}, attends {span}, starts array<long>"), "forest")
    return out.where("path is null").drop("path", "starts"), out.where("path is not null").select(F.md5("path").alias("key"), "path", "tree", "starts", "attends"), members


#: Paths through a node beyond which its join is dealt out.
CROWD = 10_000


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Conversations put together from the token ids of the nodes on their paths: key, formatted, loss (the text of the tokens under the loss mask, unescaped)."""
    path_of = tokenizer or tokenizer_path()
    # starts of a path ascend
    steps = paths.select("key", "tree", F.explode("starts").alias("start"))
    # a node that many paths share is copied, so that its steps meet it in several tasks; there is one such node to CROWD steps at most
    crowds = steps.groupBy("tree", "start").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("shares")).where("shares > 1")
    crowds = written(crowds, "crowds")
    steps = steps.join(crowds, ["tree", "start"], "left").withColumn("share", F.pmod(F.xxhash64("key"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    own = nodes.select("tree", "start", "ids", "loss_from", "loss_to").join(crowds, ["tree", "start"], "left")
    own = own.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    pieces = steps.join(own, ["tree", "start", "share"]).select("key", F.struct("start", "ids", "loss_from", "loss_to").alias("piece"))
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))

    def joined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path_of)
        for batch in _slices(batches):
            formatted, loss = [], []
            for pieces in batch["pieces"]:
                ids = [np.frombuffer(p["ids"], dtype="<u4") for p in pieces]
                formatted.append(coder.text(np.concatenate(ids)))
                loss.append("".join(unescape(coder.text(x[p["loss_from"] : p["loss_to"]])) for x, p in zip(ids, pieces) if p["loss_from"] < p["loss_to"]))
            yield pd.DataFrame({"key": batch["key"], "formatted": formatted, "loss": loss})

    return whole.mapInPandas(tidy(joined), "key string, formatted string, loss string")


def op1_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Formats all conversations and conversation -7 and returns, decoded from the ids of the trees and their loss mask: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    nodes, paths, members = prefix_trees(rows)

    def digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            turns = [parse(x) for x in batch["formatted"]]
            yield pd.DataFrame({
                "key": batch["key"],
                "n_turns": [len(t) for t in turns],
                "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns],
                "loss_chars": [len(x) for x in batch["loss"]],
                "loss_sha256": [sha(x) for x in batch["loss"]],
                "formatted_chars": [len(x) for x in batch["formatted"]],
            })

    found = read_back(nodes, paths).mapInPandas(tidy(digests), "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(found, "key").drop("key")


#: The same digests from the table itself.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn>### : </turn>') + 1 + length(role) + len(regexp_extract_all(role, '[\\:<#]')) + length(text) + len(regexp_extract_all(text, '\\|</?turn|###')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
