"""Bagged trees against trees grown row by row in numpy."""

from __future__ import annotations

from hashlib import md5

import numpy as np

from tessera.operators import bagging as bg

WIDTH, TREES, DEPTH, BINS, SOME, CLASSES = 4, 6, 3, 5, 2, ["a", "b", "c"]


def _weight(stream, tree, row):
    u = int(md5(f"0|{stream}|{tree}|{row}".encode()).hexdigest()[:8], 16) / 2**32
    p, total, k = np.exp(-1), np.exp(-1), 0
    while total <= u and k < 11:
        k += 1
        p /= k
        total += p
    return k if total > u else 12


def _data(n=240, seed=3, signal=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, WIDTH)).round(3)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1], [-0.4, 0.4]) if signal else r.integers(0, 3, n)
    return x, y


def _table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], CLASSES[b]) for i, (a, b) in enumerate(zip(x, y))], "row long, x array<double>, y string")


def _tree(tree, codes, y, w):
    """Values by node and a function from codes to a node."""
    cuts = {}

    def gain(rows):
        s = sum(w[i] * y[i] for i in rows)
        return (s**2).sum() / w[rows].sum()

    def grow(node, rows, level):
        best = (0.0, 0, 0)
        if level < DEPTH:
            for f in bg.tried(0, tree, node, WIDTH, SOME):
                for c in np.unique(codes[rows, f]):
                    a, b = rows[codes[rows, f] <= c], rows[codes[rows, f] > c]
                    if len(a) and len(b):
                        best = max(best, (round(gain(a) + gain(b) - gain(rows), 9), -f, -int(c)))
        if best[0] <= 0:
            values[node] = sum(w[i] * y[i] for i in rows) / w[rows].sum()
            return
        f, c = -best[1], -best[2]
        cuts[node] = (f, c)
        grow(2 * node, rows[codes[rows, f] <= c], level + 1)
        grow(2 * node + 1, rows[codes[rows, f] > c], level + 1)

    values = {}
    grow(1, np.flatnonzero(w > 0), 0)

    def value(code):
        node = 1
        while node in cuts:
            f, c = cuts[node]
            node = 2 * node + int(code[f] > c)
        return values[node]

    return value


def _votes(df):
    return bg.out_of_bag(df, "x", bg.one_hot("y", CLASSES), 3, width=WIDTH, id_column="row", trees=TREES, depth=DEPTH, bins=BINS, some=SOME)


def test_votes_equal_trees_in_numpy(spark):
    x, y = _data()
    df = _table(spark, x, y)
    parts = bg.borders(df, "x", WIDTH, BINS)
    for f in range(WIDTH):
        ordered = np.sort(x[:, f])
        assert parts[f] == sorted({ordered[int(np.ceil(k / BINS * len(x))) - 1] for k in range(1, BINS)})
    codes = np.stack([np.searchsorted(parts[f], x[:, f], side="left") for f in range(WIDTH)], 1)
    hot = np.eye(3)[y]
    said = {i: [] for i in range(len(x))}
    for t in range(TREES):
        w = np.array([_weight("bag", t, i) for i in range(len(x))], dtype=float)
        value = _tree(t, codes, hot, w)
        for i in np.flatnonzero(w == 0):
            said[i].append(value(codes[i]))
    found = {r.row: r for r in _votes(df.repartition(3)).collect()}
    assert len(found) == len(x)
    for i, own in said.items():
        assert found[i].trees == len(own)
        if own:
            assert np.allclose(found[i].predicted, np.mean(own, 0)) and found[i].hits == sum(int(np.argmax(v) == y[i]) for v in own)


def test_filter(spark):
    x, y = _data()
    votes = _votes(_table(spark, x, y))
    good = bg.learnable(votes, 3, "row").first()
    rows = [r for r in votes.collect() if r.predicted]
    b, e = (np.array([((np.array(r.target) - at(r)) ** 2).sum() for r in rows]) for at in (lambda r: np.eye(3)[y].mean(0), lambda r: np.array(r.predicted)))
    means = [sum(_weight("boot", k, r.row) * (b[i] - e[i]) for i, r in enumerate(rows)) for k in range(200)]
    assert good.n == len(rows) and np.isclose(good.mse, e.mean()) and np.isclose(good.baseline_mse, b.mean()) and good.p == np.mean(np.array(means) <= 0)
    assert not good.rejected and good.mse < 0.8 * good.baseline_mse
    noise = bg.learnable(_votes(_table(spark, *_data(signal=False))), 3, "row").first()
    assert noise.unpredictable and noise.rejected


def test_edges(spark):
    rows = [(1, [1.0, None, float("nan"), float("inf")], "a"), (2, None, "b"), (3, [0.0, 1.0, 2.0, 3.0], None), (4, [], "a"), (5, [5.0, 1.0, 2.0, float("-inf")], "z")]
    df = spark.createDataFrame(rows, "row long, x array<double>, y string")
    found = {r.row: r for r in _votes(df).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[3].target is None and found[5].target is None
    assert {r.row for r in bg.label_scores(_votes(df), "row").collect()} == {1, 2, 4}
    empty = _votes(df.limit(0))
    assert empty.count() == 0 and bg.learnable(empty, 3, "row").first().unpredictable
    same = spark.createDataFrame([(i, rows[0][1], "a") for i in range(40)], df.schema)
    assert all(r.hits == r.trees for r in _votes(same).where("trees > 0").collect())
