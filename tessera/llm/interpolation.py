"""Deleted interpolation: an n-gram model of maximum-likelihood estimates mixed by context frequency (operator 13).

Documents that are learned from are of two kinds: most are counted, the rest (every fifth of
all) hold out the events that the weights are learned on. A weight belongs to a bucket, the
longest context that was seen and the power of two of its frequency, and to an order of n-gram;
expectation-maximisation makes the held-out events likeliest under estimates from the counted
documents alone. Texts are then scored with estimates from both kinds under these weights.

Counts travel packed. Documents of one kind are gathered into chunks of some megabytes. A
chunk asks for the counts of its distinct n-grams: their keys, sorted, go in one row to each
range of keys, where the requests of all chunks are added up and every chunk is answered with
an array in the order it asked. So an n-gram of every text is one key a chunk, a range is a
bounded number of keys, and no row of a shuffle is a single token. A chunk computes the same
sorted keys again and reads its counts by place; contexts are the n-grams one place before.
At 100 TB chunks of 64 MB and ranges of 32 million keys keep some tens of keys in a row.

Keys have 64 bits (those of words as in the n-gram join), so counts are almost surely exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, tasks, tidy, written
from tessera.llm.jaccard import _words, lowered, mixed

#: Bytes of text in a chunk, and keys asked for in a range, about.
CHUNK, RANGE = 4 << 20, 2 << 20
#: Kinds of documents: scored only, holding out events, counted.
TEST, HELD, COUNTED = 0, 1, 2
#: Likelihoods of held-out events are gathered on a grid of so many steps an octave before weights are learned on them.
STEPS = 16
#: Most rounds of expectation-maximisation, and the gain of the mean log-likelihood that ends it.
ROUNDS, GAIN = 200, 1e-7

START, END = np.uint64(0x53A7B1E5C0DE0001), np.uint64(0x53A7B1E5C0DE0002)


def kind(column: str = "doc_id") -> Column:
    """TEST where crc32 of the identifier as text leaves 1 by 5, HELD where it leaves 0, else COUNTED, null identifiers among them."""
    left = F.crc32(F.col(column).cast("string").cast("binary")) % 5
    return F.when(left == 1, TEST).when(left == 0, HELD).otherwise(COUNTED)


def _before(values: np.ndarray, first: np.ndarray, at_start: np.generic | int) -> np.ndarray:
    """Each place's value of the place before it in its document, `at_start` at the first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = at_start
    return out


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], lengths[:-1].cumsum()]).astype(np.int64) if len(lengths) else np.zeros(0, dtype=np.int64)


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n from 1 to order the keys of the n-grams that end at each place; documents begin after starts without end."""
    out, first, pad = [words], _starts(lengths), START
    for n in range(2, order + 1):
        size = np.uint64(n)
        out.append(mixed(_before(out[-1], first, pad) + mixed(words ^ size)))
        pad = mixed(np.array([pad]) + mixed(np.array([START]) ^ size))[0]
    return out


def _tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, an end after each text, and the number of each text's tokens."""
    parts = [lowered(t) for t in texts]
    starts, words = _words(np.frombuffer(b" ".join(parts), dtype=np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    at = np.searchsorted(starts, offsets)
    return np.insert(words, at[1:], END), np.diff(at) + 1


def _narrow(values: np.ndarray) -> bytes:
    """Integers from 0 as bytes, whose first tells their width."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, all highest bytes first: the upper ones are mostly zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().cumsum(dtype=np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, kind, text) of a kind in chunks: chunk, kind, docs (identifiers), lengths (tokens of each), words (keys of the chunk's different tokens), tokens (places among them)."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def packed(of: int) -> pa.RecordBatch:
            nonlocal number
            ids, texts, _ = held.pop(of)
            words, lengths = _tokenised(texts)
            known, places = np.unique(words, return_inverse=True)
            number += 1
            row = {"chunk": number, "kind": of, "docs": ids, "lengths": _narrow(lengths), "words": _planes(known), "tokens": _narrow(places)}
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            for doc, of, text in zip(batch.column("doc_id"), batch.column("kind").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids, texts, size = held.setdefault(of, ([], [], [0]))
                ids.append(doc.as_py())
                texts.append(text)
                size[0] += len(text or "") + 32
                if size[0] >= CHUNK:
                    yield packed(of)
        for of in list(held):
            yield packed(of)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind().alias("kind"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(tidy(gather), "chunk long, kind int, docs array<long>, lengths binary, words binary, tokens binary"), "chunks")


def _unpacked(words: bytes, tokens: bytes, lengths: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = _wide(lengths).astype(np.int64)
    return sizes, grams(_keys(words)[_wide(tokens).astype(np.int64)], sizes, order)


def counts(packed: DataFrame, order: int, ranges: int) -> DataFrame:
    """Answers to what every chunk asks for: chunk, n, range, every (counts over all learned documents, by ascending key), counted (over counted ones, for chunks that hold out events, else null); and once a range, at one of its chunks, types, total and counted_total of its n-grams, else 0."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, of, words, tokens, lengths in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "words", "tokens", "lengths")), strict=True):
                for n, own in enumerate(_unpacked(words, tokens, lengths, order)[1], 1):
                    keys, often = np.unique(own, return_counts=True)
                    place = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), dtype=np.int64)
                    ends = np.searchsorted(place, np.arange(ranges + 1))
                    filled = np.flatnonzero(ends[1:] > ends[:-1])
                    parts = [(_planes(keys[ends[r] : ends[r + 1]]), _narrow(often[ends[r] : ends[r + 1]])) for r in filled]
                    m = len(filled)
                    columns = [pa.array([n] * m, pa.int32()), pa.array(filled, pa.int64()), pa.array([chunk] * m, pa.int64()), pa.array([of] * m, pa.int32()), pa.array([k for k, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["n", "range", "chunk", "kind", "keys", "often"])

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        kinds, parts = asked.column("kind").to_pylist(), [_keys(x) for x in asked.column("keys").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        known, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        every, counted = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
        for k, (of, often) in enumerate(zip(kinds, asked.column("often").to_pylist())):
            if of != TEST:
                own, at = _wide(often).astype(np.int64), inverse[ends[k] : ends[k + 1]]  # keys of a chunk are distinct
                every[at] += own
                if of == COUNTED:
                    counted[at] += own
        spots = [inverse[ends[k] : ends[k + 1]] for k in range(len(parts))]
        once = [1] + [0] * (len(parts) - 1)
        out = {
            "chunk": asked.column("chunk"), "n": asked.column("n"), "range": asked.column("range"),
            "every": pa.array([_narrow(every[s]) for s in spots], pa.binary()), "counted": pa.array([_narrow(counted[s]) if of == HELD else None for of, s in zip(kinds, spots)], pa.binary()),
            "types": pa.array([x * int((every > 0).sum()) for x in once], pa.int64()), "counted_types": pa.array([x * int((counted > 0).sum()) for x in once], pa.int64()),
            "total": pa.array([x * int(every.sum()) for x in once], pa.int64()), "counted_total": pa.array([x * int(counted.sum()) for x in once], pa.int64()),
        }
        give_back()
        return pa.table(out)

    asked = packed.select("chunk", "kind", "words", "tokens", "lengths").mapInArrow(tidy(ask), "n int, range long, chunk long, kind int, keys binary, often binary")
    # with more partitions than ranges a task has few of them
    spread = asked.repartition(tasks(packed.sparkSession), "n", "range").groupBy("n", "range")
    return written(spread.applyInArrow(answer, "chunk long, n int, range long, every binary, counted binary, types long, counted_types long, total long, counted_total long"), "counts")


@dataclass
class Known:
    """Sums over the documents that estimates are made from: tokens, types, documents."""

    total: int
    types: int
    docs: int


def _estimates(gram: list[np.ndarray], lengths: np.ndarray, answers: list[np.ndarray], known: Known) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """At each place: its bucket, the estimates of orders 1 up (0 where their context is unknown), and the counts of the tokens.

    A bucket is 64 times the length of the longest context seen, plus the power of two of its frequency; 0 if there is none.
    """
    first = _starts(lengths)
    found, context, bucket = [], np.full(len(gram[0]), known.total, dtype=np.int64), np.zeros(len(gram[0]), dtype=np.int64)
    for n, (own, counts_) in enumerate(zip(gram, answers)):
        here = counts_[np.searchsorted(np.unique(own), own)].astype(np.int64)
        if n:
            bucket = np.where(context > 0, 64 * n + np.frexp(np.maximum(context, 1).astype(np.float64))[1] - 1, bucket)
        found.append(np.divide(here, context, out=np.zeros(len(here)), where=context > 0))
        # what follows an n-gram: each occurrence has one token after it in its document
        context = _before(here, first, known.docs)
        if not n:
            tokens = here
    return bucket, found, tokens


def _orders(bucket: int, order: int, known: bool) -> np.ndarray:
    """Which estimates a bucket mixes: the uniform one, and those of orders up to one more than the length of its context."""
    return np.array([True] + [known and n <= bucket // 64 + 1 for n in range(1, order + 1)])


def learned(likely: np.ndarray, often: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Mixture weights by expectation-maximisation: likely has a row an event and a column an estimate, often how many events a row stands for. One event of each estimate is added, so that no allowed weight vanishes."""
    weights, before = allowed / allowed.sum(), -np.inf
    for _ in range(ROUNDS):
        mixed_ = likely @ weights
        now = float((often * np.log(mixed_)).sum() / often.sum())
        if now - before < GAIN:
            break
        before = now
        share = (likely * weights / mixed_[:, None] * often[:, None]).sum(0) + allowed
        weights = share / share.sum()
    return weights


def _answered(answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """A chunk's counts for each order, by ascending key."""
    rows = sorted(zip(answers.column("n").to_pylist(), answers.column("range").to_pylist(), answers.column(column).to_pylist()), key=lambda x: x[:2])
    return [np.concatenate([_wide(data) for m, _, data in rows if m == n]) for n in range(1, order + 1)]


def weights(packed: DataFrame, answers: DataFrame, order: int, known: Known) -> dict[int, list[float]]:
    """The weights of each bucket: of the uniform estimate, then of orders 1 up. Events are gathered on a grid in every task and added up; a bucket's grid is bounded and learned in one task. Empty without held-out or counted documents."""
    if not known.total:
        return {}

    def events(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for words, tokens, lengths in zip(*(left.column(c).to_pylist() for c in ("words", "tokens", "lengths"))):
            sizes, gram = _unpacked(words, tokens, lengths, order)
            bucket, found, _ = _estimates(gram, sizes, _answered(right, "counted", order), known)
            # steps below 1 on a grid of logarithms, -1 for a likelihood of 0
            steps = [np.where(f > 0, np.rint(-STEPS * np.log2(np.maximum(f, 1e-300))), -1).astype(np.int64) for f in found]
            rows.append(np.stack([bucket, *steps], axis=1))
        cells, often = np.unique(np.concatenate(rows), axis=0, return_counts=True)
        give_back()
        return pa.table({"bucket": pa.array(cells[:, 0], pa.int64()), "steps": pa.array(cells[:, 1:].tolist(), pa.list_(pa.int64())), "often": pa.array(often, pa.int64())})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        rows = rows.sort_values("steps", key=lambda s: s.map(tuple))  # sums don't depend on how rows arrive
        steps = np.stack(rows["steps"].to_list())
        likely = np.concatenate([np.full((len(steps), 1), 1 / (known.types + 1)), np.where(steps >= 0, np.exp2(-steps / STEPS), 0.0)], axis=1)
        found = learned(likely, rows["often"].to_numpy(dtype=np.float64), _orders(bucket, order, True).astype(float))
        return pd.DataFrame({"bucket": [bucket], "weights": [found.tolist()]})

    left = packed.where(F.col("kind") == HELD).groupBy("chunk")
    right = answers.where("counted is not null").select("chunk", "n", "range", "counted").groupBy("chunk")
    gathered = left.cogroup(right).applyInArrow(events, "bucket long, steps array<long>, often long")
    grid = gathered.groupBy("bucket", "steps").agg(F.sum("often").alias("often"))
    found = grid.groupBy("bucket").applyInPandas(fit, "bucket long, weights array<double>")
    return {r.bucket: list(r.weights) for r in found.collect()}  # 64 buckets an order at most


def _nearest(found: dict[int, list[float]], bucket: int, order: int, known: bool) -> np.ndarray:
    """The weights of a bucket, or of the nearest one with a context of the same length; even ones where there is none."""
    allowed = _orders(bucket, order, known)
    near = sorted((abs(b - bucket), b) for b in found if b // 64 == bucket // 64) if known else []
    own = np.array(found[near[0][1]]) if near else allowed / allowed.sum()
    return np.where(allowed, own, 0.0)


def score(docs: DataFrame, *, order: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (see op13_interpolation).

    Tokens are words, maximal runs of characters outside space and tab to carriage return with A-Z
    lower-cased, and an end after each text; null and empty texts are an end alone. Documents with a null
    identifier are learned from. Repeated rows are documents of their own, and equal texts score alike.
    Texts are scored whole, one longer than a chunk in a chunk of its own. Without documents to learn
    from every token is unknown; without held-out or counted ones weights are even. Further columns are
    ignored, whatever their names; an empty table gives an empty result. Only the counted table decides:
    no n-gram, context or event is left out at any size.
    """
    packed = chunks(docs)
    sizes = packed.select("kind", F.size("docs").alias("docs"), F.octet_length("tokens").alias("bytes"))
    rows = {r.kind: r for r in sizes.groupBy("kind").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes")).collect()}
    number = lambda *kinds: sum(rows[k].docs for k in kinds if k in rows)
    asked = sum(r.bytes for r in rows.values()) // 2  # tokens of two bytes or more, so not too few
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, asked / RANGE)))))
    answers = counts(packed, order, ranges)
    t = answers.where("n = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "counted_types", "total", "counted_total"))).first()
    found = weights(packed, answers, order, Known(t.counted_total, t.counted_types, number(COUNTED)))
    known = Known(t.total, t.types, number(HELD, COUNTED))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, words, tokens, lengths in zip(left.column("docs").to_pylist(), *(left.column(c).to_pylist() for c in ("words", "tokens", "lengths"))):
            sizes_, gram = _unpacked(words, tokens, lengths, order)
            bucket, likely, own = _estimates(gram, sizes_, _answered(right, "every", order), known)
            buckets, which = np.unique(bucket, return_inverse=True)
            mix = np.stack([_nearest(found, int(b), order, known.total > 0) for b in buckets])[which]
            p = mix[:, 0] / (known.types + 1) + sum(mix[:, n] * likely[n - 1] for n in range(1, order + 1))
            base = (own + 0.5) / (known.total + 0.5 * (known.types + 1))
            first = _starts(sizes_)
            sums = [np.add.reduceat(x, first) for x in ((own > 0).astype(np.int64), np.log10(base), np.log10(p))]
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes_, pa.int64()), "n_known": sums[0], "base_score": sums[1], "score": sums[2]}))
        give_back()
        return pa.concat_tables(out)

    cogrouped = packed.groupBy("chunk").cogroup(answers.select("chunk", "n", "range", "every").groupBy("chunk"))
    result = cogrouped.applyInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", (kind() == TEST).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def op13_interpolation(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out (crc32 of the identifier leaves 1 by 5), n_tokens, n_known, train_tokens, base_score (add-half unigrams), score (log10 probability by a bigram model with deleted interpolation)."""
    return score(docs)
