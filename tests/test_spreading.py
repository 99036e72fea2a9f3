"""Solved label spreading against a dense solution."""

from __future__ import annotations

import numpy as np

from tessera.operators import neighbours as nb
from tessera.operators import spreading as sp


def _dense(x, seeds, k, alpha, classes):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, 1)
    sigma = np.sort(near.ravel())[(near.size - 1) // 2]
    w = np.zeros_like(d)
    np.put_along_axis(w, order, np.exp(-((near / sigma) ** 2)), 1)
    w = np.maximum(w, w.T)
    root = 1 / np.sqrt(w.sum(1))
    y = np.array([[float(s == c) for c in classes] for s in seeds])
    f = np.clip(np.linalg.solve(np.eye(len(x)) - alpha * root[:, None] * w * root, (1 - alpha) * y), 0, None)
    total = f.sum(1, keepdims=True)
    return np.where(total > 1e-300, f / np.maximum(total, 1e-300), 1 / len(classes))


def test_equals_the_dense_solution(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(40, 3)), r.normal(size=(30, 3)) + 3, r.normal(size=(10, 3)) + 100])
    seeds = [("p" if i < 40 else "q") if i % 5 == 0 and i < 70 else ("other" if i == 1 else None) for i in range(80)]
    rows = spark.createDataFrame([(i, [float(v) for v in a], s) for i, (a, s) in enumerate(zip(x, seeds))], "query long, x array<double>, label string")
    near = nb.knn(rows, rows, 4, id_column="query", vector="x", square=True)
    found = {a.query: a.probs for a in sp.solved(rows.select("query", "label"), near, ["p", "q"], alpha=0.8).collect()}
    want = _dense(x, seeds, 4, 0.8, ["p", "q"])
    assert len(found) == 80
    assert max(np.abs(np.array(found[i]) - want[i]).max() for i in range(70)) < 1e-4
    assert all(found[i] == [0.5, 0.5] for i in range(70, 80))  # no seed reaches them


def test_empty(spark):
    none = spark.createDataFrame([], "query long, label string")
    near = spark.createDataFrame([], "query long, neighbour long, distance double")
    assert sp.solved(none, near, ["p"], alpha=0.5, accuracy=0.1).count() == 0
