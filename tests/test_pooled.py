"""Pooled resampling against digests one by one, and digests of many strings against hashlib."""

from __future__ import annotations

from collections import defaultdict
from hashlib import md5

import pytest

from tessera.operators import assessment as a


def _truth(rows, rounds, seed):
    """round: mean over draws of the weighted means, by one digest after the other; null draws are a draw."""
    out = {}
    for r in range(rounds):
        over, under, known = defaultdict(float), defaultdict(int), set()
        for draw, value, name in rows:
            u = int(md5("|".join([str(seed), "pooled", str(r), *(str(x) for x in (draw, name) if x is not None)]).encode()).hexdigest()[:8], 16) / 2**32
            w, p, total = 0, 0.36787944117144233, 0.0
            for k in range(12):
                total += p
                w += total <= u
                p /= k + 1
            under[draw] += w
            if value is not None:
                known.add(draw)
                over[draw] += w * value
        means = [over[d] / under[d] for d in under if under[d] and d in known]
        out[r] = sum(means) / len(means) if means else None
    return out


@pytest.mark.parametrize("batch", [1, 7, 1 << 15])
def test_equals_digests_one_by_one(spark, monkeypatch, batch):
    # nulls in each column, a draw without values, one of one row, names over several blocks, empty and beyond ASCII
    rows = [(i % 3 if i % 11 else None, float(i % 10) if i % 7 else None, "é" * (i % 90) + str(i) if i % 5 else None) for i in range(200)]
    rows += [(7, None, "x"), (7, None, "y"), (8, 3.5, ""), (None, 2.0, None)]
    monkeypatch.setattr(a, "BATCH", batch)
    df = spark.createDataFrame(rows, "d int, v double, k string").repartition(3)
    found = {r["round"]: r["mean"] for r in a.pooled_means(df, "d", "v", 12, "k", 5).collect()}
    want = _truth(rows, 12, 5)
    assert found.keys() == want.keys()
    assert all(abs(found[r] - want[r]) < 1e-12 for r in want)


def test_other_kinds_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 4, 2), (None, 9, 3)], "d string, v int, k long")
    found = {r["round"]: r["mean"] for r in a.pooled_means(df, "d", "v", 9, "k").collect()}
    assert found == pytest.approx(_truth([tuple(r) for r in df.collect()], 9, 0))
    assert a.pooled_means(df.where("k > 5"), "d", "v", 9, "k").count() == 0


def test_no_row_for_each_round_and_row(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "d int, v double, k string")
    plan = a.pooled_means(df, "d", "v", 50, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "md5(" not in plan


def test_first_words():
    from tessera.functions.digests import first_words

    tails = [bytes((7 * i + k) % 256 for i in range(k)) for k in range(200)] + [b"\0", b"ab\0"]
    heads = [b"", b"x" * 60, b"0|pooled|1", b"0|pooled|2", b"0|pooled|12", b"y" * 130]
    for head, words in zip(heads, first_words(heads, tails)):
        assert words.tolist() == [int(md5(head + t).hexdigest()[:8], 16) for t in tails]
    assert [len(w) for w in first_words(heads, [])] == [0] * 6
