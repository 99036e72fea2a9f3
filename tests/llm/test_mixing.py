from __future__ import annotations

import random
import re

import numpy as np

from tessera.llm import mixing


def _targets(sizes: dict) -> dict:
    """Brute force: share by weight, stop what is above, share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed: dict = {}
    total = sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        share = {s: room * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def _docs(spark):
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < 0.4 else r.choice(["a", "B", "é", None, "tiny"]) if r.random() < 0.97 else "tiny", " ".join(["w"] * r.choice([0, 1, 5, 40, 300]))) for i in range(12000)]
    rows += [(1, "hot", "same row"), (1, "hot", "same row"), (None, "a", "x y"), (5, None, None), (7, "empty", ""), (8, "empty", " \t ")]
    return rows, spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, source string, text string, size int")


def test_mix(spark):
    rows, docs = _docs(spark)
    found = mixing.op3_mix(docs).collect()
    again = mixing.op3_mix(docs.repartition(7)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, docs_taken = _targets(sizes), {}, {}
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
        docs_taken[r.source] = docs_taken.get(r.source, 0) + r.copies
    for s, n in taken.items():
        assert abs(n - want[s]) <= 600, (s, n, want[s])
        if sizes[s]:
            assert abs(docs_taken[s] - sum(1 for x in rows if x[1] == s) * want[s] / sizes[s]) < 4


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 40).astype(float)
    mean = np.zeros(40)
    for k in range(400):
        p = mixing.fly(np.full(40, 0.3), np.ones(40), words, np.random.default_rng(k))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - 12) < 1e-6 and abs(p @ words - 0.3 * words.sum()) < 1e-5
        mean += mixing.land(p, words, np.random.default_rng(k)) / 400
    assert abs(mean - 0.3).max() < 0.12


def test_empty(spark):
    assert mixing.op3_mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_repeated(spark):
    _, docs = _docs(spark)
    out = mixing.repeated(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.op3_mix(docs).collect())


def test_rows_without_identifier_meet_their_target(spark):
    rows = [(None, "a", "one two three four five six seven") for _ in range(4000)] + [(None, "b", f"w{i} b c d e f g") for i in range(3000)] + [(i, "c", "x " * 9) for i in range(500)]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, source string, text string, __size int")
    found = mixing.op3_mix(docs).collect()
    assert len(found) == len(rows)
    taken, target = {}, {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    out = mixing.repeated(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r["__size"]] = counts.get(r["__size"], 0) + 1
    assert sum(counts.values()) == sum(r.copies for r in found) and max(counts.values()) <= 3
