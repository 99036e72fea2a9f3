from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import interpolation
from tessera.llm.interpolation import STEPS, learned


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def _grams(text, order):
    """For each token its n-grams from 1 to order, of histories that begin with starts."""
    words = _tokens(text)
    full = ["<s>"] * order + words
    return [[tuple(full[k + order + 1 - n : k + order + 1]) for n in range(1, order + 1)] for k in range(len(words))]


def _truth(rows, order):
    """Scores by dictionaries of n-grams; the grid of likelihoods and the fit are the operator's own."""
    left = [zlib.crc32(str(i).encode()) % 5 if i is not None else 2 for i, _ in rows]

    def model(of):
        counts, context = Counter(), Counter()
        for (_, t), r in zip(rows, left):
            if r in of:
                for own in _grams(t, order):
                    counts.update(own)
                    context.update(g[:-1] for g in own)
        return counts, context

    def estimates(own, counts, context):
        bucket, found = 0, []
        for n, g in enumerate(own):
            c = context[g[:-1]]
            if n and c:
                bucket = 64 * n + int(math.log2(c))
            found.append(counts[g] / c if c else 0.0)
        return bucket, found

    counts, context = model((2, 3, 4))
    types = sum(len(g) == 1 for g in counts)
    events = defaultdict(Counter)
    for (_, t), r in zip(rows, left):
        if r == 0 and types:
            for own in _grams(t, order):
                bucket, found = estimates(own, counts, context)
                events[bucket][tuple(round(-STEPS * math.log2(f)) if f else -1 for f in found)] += 1
    weights = {}
    for bucket, cells in events.items():
        cells = sorted(cells.items())
        likely = np.array([[1 / (types + 1)] + [2 ** (-s / STEPS) if s >= 0 else 0.0 for s in steps] for steps, _ in cells])
        weights[bucket] = learned(likely, np.array([float(n) for _, n in cells]), np.array([1.0] + [float(n <= bucket // 64 + 1) for n in range(1, order + 1)]))
    counts, context = model((0, 2, 3, 4))
    n, v = context[()], sum(len(g) == 1 for g in counts)
    out = []
    for (i, t), r in zip(rows, left):
        base = total = known = 0
        for own in _grams(t, order):
            c = counts[own[0]]
            known += c > 0
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            bucket, found = estimates(own, counts, context)
            near = sorted((abs(b - bucket), b) for b in weights if b // 64 == bucket // 64) if n else []
            allowed = [True] + [n > 0 and k <= bucket // 64 + 1 for k in range(1, order + 1)]
            w = weights[near[0][1]] if near else [a / sum(allowed) for a in allowed]
            total += math.log10(w[0] / (v + 1) + sum(w[k + 1] * f for k, f in enumerate(found) if allowed[k + 1]))
        out.append((i, r == 1, len(_tokens(t)), known, n, base, total))
    return out


def _close(found, want):
    key = lambda x: (str(x[0]), x[2], round(x[5], 6), round(x[6], 6))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for x, y in zip(found, want) for a, b in zip(x[5:], y[5:]))


def _rows(n, seed=3):
    r = random.Random(seed)
    words, rows = [f"w{k}" for k in range(40)], []
    for k in range(n):
        text, at = [], r.randrange(40)
        for _ in range(r.choice([0, 1, 5, 40])):
            at = (at * 3 + r.choice([1, 1, 1, 7])) % 40 if r.random() < 0.9 else r.randrange(40)
            text.append(words[at].upper() if r.random() < 0.1 else words[at])
        rows.append((k, r.choice([" ", "\n", "\x1c"]).join(text)))
    return rows + [(n, None), (n + 1, ""), (None, "w1 w2 w3"), (2, "never seen wörds"), (3, "w1 " * 5000), *rows[:5], *rows[:5]]


@pytest.mark.parametrize(("order", "chunk", "span"), [(2, 4 << 20, 4 << 20), (2, 500, 100), (3, 800, 300), (1, 700, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, order, chunk, span):
    monkeypatch.setattr(interpolation, "CHUNK", chunk)
    monkeypatch.setattr(interpolation, "RANGE", span)
    rows = _rows(250)
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, chunk string, kind int").repartition(3)
    _close(interpolation.score(df, order=order).collect(), _truth(rows, order))


def test_degenerate_tables(spark):
    schema = "doc_id long, text string"
    by = lambda left: [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == left][:4]
    for ids in (by(1), by(0), by(2), by(1) + by(2), by(1) + by(0)):
        rows = [(k, "a b a" if k % 2 else "b c") for k in ids]
        _close(interpolation.op13_interpolation(spark.createDataFrame(rows, schema)).collect(), _truth(rows, 2))
    empty = interpolation.op13_interpolation(spark.createDataFrame([], schema))
    assert empty.collect() == []
    assert dict(empty.dtypes)["train_tokens"] == "bigint"


def test_beats_unigrams(spark):
    rows = [r for r in _rows(400, 5) if len(r[1] or "") < 1000]  # one text of 5000 equal words would be most of what holds out events
    found = interpolation.op13_interpolation(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in found)


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (interpolation._keys(interpolation._planes(keys)) == keys).all()
    for top in (3, 300, 70_000, 2**40):
        values = np.array([0, 1, top], dtype=np.int64)
        assert (interpolation._wide(interpolation._narrow(values)) == values).all()
