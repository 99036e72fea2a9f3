"""Queries that read whole tables, against brute force on small ones with rows beyond every prefix."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.functions.keys import key
from tessera.operators import loops, neighbours, sampling
from tessera.plans import catalog


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    ids = rng.permutation(600)[:320]
    label = rng.integers(0, 10, 320)
    x = (rng.normal(size=(320, 64)) + 0.6 * rng.normal(size=(10, 64))[label]).astype(np.float32)
    x[:40] = x[40]  # one vector many times
    path = str(tmp_path_factory.mktemp("small"))
    rows = [(int(i), [float(a) for a in v], int(c)) for i, v, c in zip(ids, x, label)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: (np.array(v), c) for i, v, c in rows}


def _near(rows, among, i, k):
    return sorted((float(np.sqrt(((rows[j][0] - rows[i][0]) ** 2).sum())), j) for j in among if j != i)[:k]


def test_label_spreading(spark, small):
    path, rows = small
    near = {i: [j for _, j in _near(rows, rows, i, 5)] for i in rows}
    start = {i: {rows[i][1]: 1.0} for i in rows if i % 4 == 0}
    state = start
    for _ in range(3):
        new = {}
        for i in rows:
            for j in near[i]:
                for c, w in state.get(j, {}).items():
                    new.setdefault(i, {})[c] = new.get(i, {}).get(c, 0) + 0.9 * w / 5
            for c in start.get(i, {}):
                new.setdefault(i, {})[c] = new.get(i, {}).get(c, 0) + 0.1
        state = new
    found = {r.query: r.weight for r in catalog.queries()["label_spreading"](spark, path).collect()}
    assert set(found) == set(state) and max(found) > 200
    assert all(abs(found[i] - sum(state[i].values())) < 2e-6 for i in found)


def test_greedy_growth(spark, small):
    path, rows = small
    accepted, rest, want = [i for i in rows if i % 4 == 0], [i for i in rows if i % 4], {}
    for step in range(50):
        m = min(60 - len(want), max(1, math.ceil(len(accepted) * 0.5)))
        if m <= 0:
            break
        score = {i: sum(rows[j][1] == rows[i][1] for _, j in _near(rows, accepted, i, 5)) / 5 for i in rest}
        best = sorted(rest, key=lambda i: (-round(score[i], 9), i))[:m]
        want |= dict.fromkeys(best, step)
        accepted, rest = accepted + best, [i for i in rest if i not in best]
    found = {r.row_id: r.step for r in catalog.queries()["greedy_growth"](spark, path).collect()}
    assert found == want and max(found) > 160


@pytest.mark.parametrize("square", [False, True])
def test_neighbours_of_all_rows(spark, small, square):
    path, rows = small
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    found = {}
    for r in neighbours.knn(e, e, 7, id_column="vec_id", vector="embedding", square=square).collect():
        found.setdefault(r.query, []).append((r.rank, r.neighbour, r.distance))
    assert {i: [(j, d) for _, j, d in sorted(found[i])] for i in found} == {i: [(j, pytest.approx(d, abs=1e-9)) for d, j in _near(rows, rows, i, 7)] for i in rows}


def test_balanced_rows_ranks_in_ranges(spark):
    df = spark.range(0, 5000, 1, 8).withColumnRenamed("id", "vec_id")
    dealt = sampling.balanced_rows(df, 6, 2500, "vec_id", 3)
    assert "SinglePartition" not in dealt._jdf.queryExecution().executedPlan().toString()
    order = [r.vec_id for r in df.orderBy(key(3, "balanced", "vec_id"), "vec_id").collect()]
    want = [(slot // 2500, order[slot % 5000]) for slot in range(15000)]
    assert sorted(tuple(r) for r in dealt.collect()) == sorted(want)
    assert sampling.balanced_rows(df.limit(0), 6, 2500, "vec_id").count() == 0


def test_shapley_ranks_all(spark, small, monkeypatch):
    path, rows = small
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    near = neighbours.knn(e, e.where("vec_id % 25 = 0"), None, id_column="vec_id", vector="embedding")
    found = {(r.query, r["rank"]): r.neighbour for r in near.collect()}
    assert found == {(i, k): j for i in rows if i % 25 == 0 for k, (_, j) in enumerate(_near(rows, rows, i, None), 1)}
    asked, knn = [], neighbours.knn
    monkeypatch.setattr(neighbours, "knn", lambda c, q, k, **more: asked.append(k) or knn(c, q, k, **more))
    catalog.queries()["knn_shapley"](spark, path)
    assert asked == [None]


def test_schedules():
    size = lambda how, amount, left=40: loops.step_size(how, amount, rows=90, accepted=25, left=left)
    assert [size("oneshot", 0), size("m", 7), size("pct", 5), size("frac", 0.3), size("shrink", 0.3), size("both", 0.3)] == [40, 7, 5, 8, 12, 8]
    assert [size("frac", 9), size("shrink", 0.001), size("both", 0.3, 10), size("m", 7, 0)] == [40, 1, 3, 0]
    with pytest.raises(ValueError):
        size("half", 0.5)
    with pytest.raises(ValueError):
        loops.schedule(100, 0, "pct", 5)
