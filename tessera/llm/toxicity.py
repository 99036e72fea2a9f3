"""Toxicity scores by a linear classifier on character n-grams (operator 4).

Features are the hashed character n-grams that a lower-cased text contains. Each is
scaled by its naive Bayes log-count ratio, the logarithm of how much more frequent
it is among texts of label 1 than of label 0; a logistic regression on the scaled
features gives the weights. Of all buckets those with the largest likelihood-ratio
statistic between the classes are kept, so a model is a short table of weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import fresh, give_back, held_out, labelled, tidy

LENGTHS = (3, 4, 5, 6)
BITS = 18
#: Characters that are hashed at a time.
WINDOW = 1 << 19


def _windows(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, first positions, documents): documents end to end, each after and before as many zeros as keep n-grams apart; long ones in overlapping windows. An n-gram that begins or ends on a zero is none."""
    gap = np.zeros(max(LENGTHS) - 1, dtype=np.uint32)
    parts, starts, owners, held = [gap], [], [], len(gap)
    for k, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, max(1, len(points)), WINDOW):
            part = points[max(0, at - len(gap)) : at + WINDOW]
            starts.append(held)
            owners.append(k)
            parts += [part, gap]
            held += len(part) + len(gap)
            if held >= WINDOW:
                yield np.concatenate(parts), np.array(starts), np.array(owners)
                parts, starts, owners, held = [gap], [], [], len(gap)
    if starts:
        yield np.concatenate(parts), np.array(starts), np.array(owners)


def _buckets(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n: the buckets of the n-grams at every position."""
    code = points.astype(np.uint32) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    rolling = code.copy()
    for n in range(2, max(LENGTHS) + 1):
        rolling = rolling[: len(code) - n + 1] * np.uint32(0x01000193 * 2 + 1) + code[n - 1 :]
        if n in LENGTHS:
            yield n, ((rolling ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def occurrences(texts: Iterable[str | None], slot: np.ndarray) -> np.ndarray:
    """Distinct pairs document * slots + slot, sorted, of the n-grams whose bucket has a slot (slot[bucket] >= 0)."""
    slots, found = int(slot.max(initial=-1)) + 1, []
    for points, starts, owners in _windows(texts):
        for n, buckets in _buckets(points):
            own = slot[buckets]
            at = np.flatnonzero(own >= 0)
            at = at[(points[at] > 0) & (points[at + n - 1] > 0)]
            where = np.searchsorted(starts, at, side="right") - 1
            found.append(np.unique(owners[where].astype(np.int64) * slots + own[at]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def document_counts(texts: Iterable[str | None]) -> np.ndarray:
    """Number of texts that contain each bucket."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    for text in texts:
        seen = np.zeros(1 << BITS, dtype=bool)
        for points, _, _ in _windows([text]):
            for n, buckets in _buckets(points):
                seen[buckets[(points[: len(buckets)] > 0) & (points[n - 1 :] > 0)]] = True
        total += seen
    return total


class Model:
    """slot: the slot of each bucket or -1; weights of slots; bias."""

    def __init__(self, slot: np.ndarray, weights: np.ndarray, bias: float):
        self.slot, self.weights, self.bias = slot, weights, bias

    def score(self, texts: pd.Series) -> np.ndarray:
        """Probability of label 1 for each text; a null text counts as an empty one."""
        total, n = np.full(len(texts), self.bias), len(self.weights)
        if n:
            pairs = occurrences(texts, self.slot)
            total += np.bincount(pairs // n, weights=self.weights[pairs % n], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with squared penalty on a sparse matrix, by Nesterov's method with a step from a power iteration."""
    n = max(1, len(y))
    v = np.ones(width)
    for _ in range(12):
        v = np.bincount(columns, weights=values * np.bincount(rows, weights=values * v[columns], minlength=n)[rows], minlength=width)
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1 / (0.25 * (top + n) / n + penalty)
    w, b = np.zeros(width), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    aw, ab, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ab + np.bincount(rows, weights=values * aw[columns], minlength=n), -40, 40)))
        off = (p - y) / n
        nw = aw - rate * (np.bincount(columns, weights=values * off[rows], minlength=width) + penalty * aw)
        nb, nt = ab - rate * off.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        aw, ab = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", *, most: tuple[int, int] = (8000, 4000), features: int = 4096, smoothing: float = 1.0, penalty: float = 1e-4, steps: int = 150) -> Model:
    """A model from at most most[0] rows of label 0 and most[1] of label 1 that aren't held out. Without rows of both labels it gives the share of label 1 to any text, 0.5 without rows."""
    sample = labelled(docs, labels, target, most, {"text": "text"}).coalesce(8)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for y in (0, 1):
                own = batch.loc[batch["y"] == y, "text"]
                found[y] += document_counts(own)
                rows[y] += len(own)
        yield pd.DataFrame({"y": [0, 1], "n": rows, "counts": [c.astype("<i4").tobytes() for c in found]})

    counts, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in sample.mapInPandas(tidy(count), "y int, n long, counts binary").collect():  # eight tasks, a megabyte a class
        counts[r.y] += np.frombuffer(r.counts, dtype="<i4")
        n[r.y] += r.n
    if not n.all():
        share = (n[1] + 0.5) / (n.sum() + 1)
        return Model(np.full(1 << BITS, -1, dtype=np.int32), np.zeros(0), float(np.log(share / (1 - share))))
    ratio = np.log((counts[1] + smoothing) / (n[1] + 2 * smoothing)) - np.log((counts[0] + smoothing) / (n[0] + 2 * smoothing))
    kept = _largest(counts, n, features)
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[kept] = np.arange(len(kept))

    def present(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = occurrences(batch["text"], slot)
            cut = np.searchsorted(pairs // len(kept), np.arange(1, len(batch)))
            yield pd.DataFrame({"y": batch["y"], "slots": [p.astype("<u2").tobytes() for p in np.split(pairs % len(kept), cut)]})

    rows = sample.mapInPandas(tidy(present), "y int, slots binary").collect()  # sum(most) rows of kept n-grams
    lists = [np.frombuffer(r.slots, dtype="<u2").astype(np.int64) for r in rows]
    columns = np.concatenate(lists)
    weights, bias = logistic(np.repeat(np.arange(len(rows)), [len(x) for x in lists]), columns, ratio[kept][columns], np.array([r.y for r in rows], dtype=float), len(kept), penalty, steps)
    return Model(slot, weights * ratio[kept], bias)


def _largest(counts: np.ndarray, n: np.ndarray, features: int) -> np.ndarray:
    """The buckets with the largest likelihood-ratio statistic between presence and class, in order."""
    total, all_rows = counts.sum(0), n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, expected: np.where(seen > 0, seen * np.log(seen / expected), 0.0)
        g = sum(term(counts[y], total * n[y] / all_rows) + term(n[y] - counts[y], (all_rows - total) * n[y] / all_rows) for y in (0, 1))
    return np.sort(np.argsort(-g, kind="stable")[: min(features, int((g > 1).sum()), 1 << 16)])


def score_sql(model: Model, docs: DataFrame, column: str = "text") -> Column:
    """The score of a text column, as an Arrow function of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weights, model.bias))

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for part in parts:
            yield pd.Series(own.score(part))
        give_back()

    return score(F.col(column))


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted (1 from 0.5 on). Null and empty texts get the score of the bias; rows with a null doc_id are never held out; repeated rows score alike."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_sql(train(docs, labels), docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 0, with all their columns, whatever their names."""
    score = fresh("__score", docs.columns)
    return docs.withColumn(score, score_sql(train(docs, labels), docs)).where(F.col(score) < 0.5).drop(score)
