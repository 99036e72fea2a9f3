from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def _truth(docs):
    sets = [_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[k]) - both):
                up[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((((d is None, d or 0), len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def _docs(seed, families=14, size=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    shared, docs = [word() for _ in range(60)], []
    for f in range(families):
        base = [word() for _ in range(r.choice([3, 4, 5, 9, 10, 14, 25, 60, 200, 700]))]
        if f % 3 == 0:
            base[1:1] = shared
        for _ in range(r.choice([1, 2, size])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, max(1, len(base) // 50), max(1, len(base) // 25)])):
                copy[r.randrange(len(copy))] = word()
            docs.append((r.choice([" ", "\n"]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    order = r.sample(range(1000), len(docs))
    return list(zip(order, docs))


def _found(spark, docs):
    rows = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, size int, digest string")
    return sorted((((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = _docs(seed) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (None, "one two"), (None, "only null"), (2006, "x" * 70000 + " y z w")]
    assert _found(spark, docs) == _truth(docs)


def test_empty_and_alone(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(4, "a b c d e f g h")]) == [((False, 4), 5, 4)]


def test_signatures_meet():
    r = random.Random(1)
    for k in range(1500):
        n = r.choice([6, 7, 8, 15, 16, 17, 31, 33, 64, 100, 250])
        x = set((np.random.default_rng(k).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)).tolist())
        y = set(x)
        for _ in range(r.randrange(0, n // 6 + 2)):
            y.discard(r.choice(sorted(y))) if r.random() < 0.5 else y.add(r.getrandbits(64))
        if x != y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = (jaccard.signatures(np.array(sorted(s), dtype=np.uint64), 85).tolist() for s in (x, y))
            assert set(a) & set(b)


def test_tree_loses_no_similar_set():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 9, (3000, 32)) * rng.integers(1, 6, (3000, 1))
    points[1500:] = np.maximum(points[:1500] + rng.integers(-1, 2, (1500, 32)), 0)
    tree = jaccard.CountTree(points)
    for k in range(0, 3000, 97):
        a, b = points[k].sum(), points.sum(1)
        want = np.flatnonzero(np.minimum(points, points[k]).sum(1) * 185 >= 85 * (a + b))
        assert tree.near(points[k], 85).tolist() == want.tolist()


def test_points_of_two_lengths_bound_the_overlap():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[:250], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
    a, b = jaccard.together([jaccard.point(x), jaccard.point(y)])
    assert len(a) == len(b) == 128 and a.sum() == len(x) and b.sum() == len(y)
    assert np.minimum(a, b).sum() >= len(np.intersect1d(x, y))


def test_connected(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = {r.node: r.label for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == up[x] for x in up)


def test_without_copies(spark):
    docs = _docs(5) + [(3000, ""), (3001, None), (None, ""), (None, "a b")]
    df = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, source string")
    kept = jaccard.without_copies(df)
    assert kept.columns == df.columns
    want = {c for (missing, d), _, c in _truth(docs) if not missing and c == d}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_links_come_from_the_trees(spark, monkeypatch, sf):
    """Without what the trees yield only equal sets are together."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = jaccard.near_duplicates(docs, n=4, percent=85).select("doc_id", "component_id").distinct().collect()
    searched = jaccard._searched
    monkeypatch.setattr(jaccard, "_searched", lambda *args: searched(*args).limit(0))
    alone = jaccard.near_duplicates(docs, n=4, percent=85).select("doc_id", "component_id").distinct().collect()
    lost = set(map(tuple, found)) - set(map(tuple, alone))
    assert lost and all(a >= b for a, b in lost)
