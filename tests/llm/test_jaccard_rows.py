"""Rows that the near-copies stage keeps, and words whose hashes must differ."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import jaccard


def _kept(spark, rows, schema="doc_id long, text string"):
    return sorted(map(tuple, jaccard.without_copies(spark.createDataFrame(rows, schema), n=5, percent=80).collect()), key=str)


def test_rows_that_share_an_identifier_stay_apart(spark):
    a, other = "one two three four five six seven", "quite another text of seven words here"
    assert _kept(spark, [(1, a), (5, a), (5, other)]) == [(1, a), (5, other)]
    assert _kept(spark, [(1, a), (1, other), (1, other)]) == sorted([(1, a), (1, other)])
    assert _kept(spark, [(None, a), (None, a), (7, "")]) == [(7, ""), (None, a)] or _kept(spark, [(None, a), (None, a)]) == [(None, a)]
    assert _kept(spark, [(3, None), (3, None), (4, " ")]) == sorted([(3, None), (3, None), (4, " ")], key=str)


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "x", 5, 2), (2, "a b c d e f", 1, "y", 6, 2), (2, "g", 1, "z", 7, 2)]
    schema = "doc_id long, text string, __id int, __print string, __hit int, node int"
    assert [r[3] for r in _kept(spark, rows, schema)] == ["x", "z"]


def _doubled(k):
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_words_of_the_doubling_string_differ(spark):
    x, y = _doubled(11)
    sets = [jaccard.shingle_set(w) for w in (x, y)]
    assert len(x) == 2048 and sets[0].tolist() != sets[1].tolist()
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_hashes_equal_by_chunks():
    r = random.Random(0)
    texts = [" ".join(r.choice(["a", "bb", "Ccc", "ddddddddd", "日本語", "x" * 40]) for _ in range(r.randrange(12))) + r.choice(["", " ", "\n"]) for _ in range(300)] + [None, "", " "]
    whole = list(jaccard.shingle_sets(texts, 4))
    assert len(whole) == len(texts)
    for t, s in zip(texts, whole):
        assert s.tolist() == jaccard.shingle_set(t, 4).tolist() and len(s) == len(jaccard.shingles(t, 4))
    old, jaccard.CHUNK = jaccard.CHUNK, 50
    try:
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, jaccard.shingle_sets(texts, 4), strict=True))
    finally:
        jaccard.CHUNK = old


def _chosen(sets, percent):
    """The keys of each set that the order by rarity leaves, as the operator chooses them."""
    all_keys = [jaccard.keys(np.array(sorted(s), dtype=np.uint64), percent) for s in sets]
    often = {}
    for ks, _ in all_keys:
        for k in ks.tolist():
            often[k] = often.get(k, 0) + 1
    out = []
    for ks, spare in all_keys:
        kept = set()
        for parity in (0, 1):
            own = sorted((k for k in ks.tolist() if k & 1 == parity), key=lambda k: (-(k & 2), -often[k], -k))
            kept |= set(own[max(0, spare[parity]) :])
        out.append(kept)
    return out


def test_rarest_keys_meet():
    r = random.Random(4)
    for percent in (80, 85):
        sets = []
        for k in range(400):
            n = r.choice([5, 6, 7, 8, 11, 15, 16, 17, 27, 31, 33, 64, 100, 250, 700])
            x = set((np.random.default_rng(k).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)).tolist())
            for _ in range(3):
                y = set(x)
                for _ in range(r.randrange(0, n * (100 - percent) // percent + 1)):
                    y.discard(r.choice(sorted(y))) if r.random() < 0.5 else y.add(r.getrandbits(64))
                sets += [x, y]
        chosen, pairs = _chosen(sets, percent), 0
        for a in range(0, len(sets), 6):
            for i in range(a, a + 6):
                for j in range(a, i):
                    x, y = sets[i], sets[j]
                    if x != y and 100 * len(x & y) >= percent * len(x | y):
                        pairs += 1
                        assert chosen[i] & chosen[j]
        assert pairs > 500
