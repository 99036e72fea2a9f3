"""Steps whose shuffles, tasks or memory must not grow faster than the input, against the plain way on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tessera.operators import forecast, neighbours, periods, ranks, sampling
from tessera.operators.series import Series
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def test_shapley_shuffles_no_pairs(spark):
    plan = catalog.queries()["knn_shapley"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_shapley_by_queries_equals_all_pairs(spark, metric):
    """Copies tie, null labels give no match, an infinite vector has no rank."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.integers(1, 4, 3)], None if i % 11 == 5 else int(rng.integers(0, 3))) for i in rng.permutation(150)]
    rows.append((700, [float("inf"), 1.0, 1.0], 1))
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    asked = df.where("id % 3 = 0")
    near = neighbours.knn(df, asked, None, id_column="id", vector="v", metric=metric, carry=("label",))
    want = {r.neighbour: r.value for r in neighbours.shapley(near, asked.selectExpr("id as query", "label as own"), 4).collect()}
    found = {r.neighbour: r.value for r in neighbours.knn(df, asked, None, id_column="id", vector="v", metric=metric, carry=("label",), mean_of=neighbours.shapley_values(4)).collect()}
    assert found.keys() == want.keys() and len(want) == 150
    assert all(found[i] == want[i] or abs(found[i] - want[i]) < 1e-12 for i in want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_of_a_class_are_not_all_shuffled(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS c")
    quota = {None: 7, 1: 40, 2: 0}
    found = sampling.take_quota(df, "c", quota, "id")
    assert _plan(found).count("WindowGroupLimit") == 2 and "Join" not in _plan(found)
    ranked = sampling.ranked(df, "c", "id").collect()
    assert {r.id for r in found.collect()} == {r.id for r in ranked if r["rank"] <= quota[r.c]}
    assert {(r.id, r.c) for r in sampling.per_class(df, "c", 30, "id").collect()} == {(r.id, r.c) for r in ranked if r["rank"] <= 30}


def test_small_classes_need_no_ranges(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id % 2 END AS c", "id * 7 % 13 AS x")
    places = lambda d: {r.id: r.place for r in d.collect()}
    whole = ranks.numbered_within(df, ["c"], ["x", "id"], "place")
    assert _plan(whole).count("Window") == 1
    monkeypatch.setattr(ranks, "ONE_TASK", 50)
    dealt = ranks.numbered_within(df, ["c"], ["x", "id"], "place")
    assert _plan(dealt).count("Window") > 1 and "SortMergeJoin" not in _plan(dealt)
    assert places(whole) == places(dealt)


def test_a_range_is_a_task_and_no_side_of_cutmix_is_broadcast(spark):
    placed = _plan(ranks.numbered(spark.range(1000).selectExpr("id * 7 % 1000 AS x"), ["x"], "n"))
    assert "REPARTITION" in placed and "hashpartitioning(__range" not in placed
    assert "Broadcast" not in _plan(catalog.queries()["cutmix"](spark, SF))


def test_items_stream_through_the_model(spark):
    """Items that cross batches, long futures in parts, items of one side alone and columns of both sides."""
    t0 = datetime(2024, 1, 1)
    past = [(f"i{i}", t0 + timedelta(hours=h), float(i * 100 + h), h) for i in range(9) if i != 4 for h in range(i + 2)]
    ahead = [(f"i{i}", t0 + timedelta(days=9, hours=h), h + 50) for i in range(8) for h in range(2 * i + 1)]
    context = Series(spark.createDataFrame(past, "item_id string, timestamp timestamp_ntz, target double, hour int"))
    future = spark.createDataFrame(ahead, "item_id string, timestamp timestamp_ntz, hour int")

    def model(left, right, levels):
        assert list(left.columns) == ["timestamp", "target", "hour"] and list(right.columns) == ["step", "timestamp", "hour"]
        assert right["hour"].dtype == "int32" and left["timestamp"].is_monotonic_increasing
        base = left["target"].sum() if len(left) else float("nan")
        return {"target": base + right["hour"].to_numpy() + right["step"].to_numpy() / 1000} | {a: base + np.full(len(right), a) for a in levels}

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = forecast.forecast(context, future, model, [0.1, 0.9], most=5, part=6)
        assert "FlatMapCoGroupsInPandas" not in _plan(found)
        got = {(r.item_id, r.timestamp): (r.target, r.quantiles) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(got) == len(ahead)
    for i, t, h in ahead:
        last = [y for j, _, y, _ in past if j == i][-5:]
        want = (sum(last) + h + (h - 49) / 1000, [sum(last) + 0.1, sum(last) + 0.9]) if last else (None, [None, None])
        assert got[i, t] == (want[0] if want[0] is None else pytest.approx(want[0]), want[1])


@pytest.mark.parametrize("together", [64, 256])
def test_spectrum_in_parts(monkeypatch, together):
    monkeypatch.setattr(periods, "TOGETHER", together)
    rng = np.random.default_rng(0)
    for n in (5, 17, 100, 1000, 4097):
        t = np.arange(n)
        y = rng.normal(size=n) + np.sin(2 * np.pi * t / 12) + 0.01 * t + 5
        z = (y - np.polyval(np.polyfit(t, y, 1), t)) * np.hanning(n)
        _, first, _, wide, _ = periods._parts(n)
        blocks = {}
        for g in range(-(-first // wide)):
            some = t % first // wide == g
            for block, piece in periods._transformed(z[some], t[some], n, g):
                blocks.setdefault(block, {})[g] = piece
        found = [periods._peaks(pieces, n, block, 3) for block, pieces in blocks.items()]
        highest = max(h for h, _ in found)
        got = {}
        for _, p, m in sorted((x for _, some in found for x in some if x[2] >= 0.05 * highest), key=lambda x: (-x[2], x[0])):
            if p not in got and len(got) < 3:
                got[p] = pytest.approx(m, rel=1e-9)
        assert list(got.items()) == periods.find_periods(y, 3)


def test_a_long_series_is_many_tasks(spark, monkeypatch):
    """One long series and a short one, of timestamps, with values that are none."""
    rows = spark.range(0, 300_000, 1, 8).selectExpr("CASE WHEN id % 1000 > 0 THEN 'long' END AS g", "timestamp_micros(id * 1000000) AS t", "CASE WHEN id % 501 = 7 THEN double('NaN') WHEN id % 501 > 0 THEN sin(2 * pi() * id / 40) + pmod(xxhash64(id), 100) / 300 + id / 1e6 END AS y")
    monkeypatch.setattr(periods, "LONG", 1 << 30)
    whole = periods.periods(rows, "g", "t", "y", 3).collect()
    monkeypatch.undo()
    parts = periods.periods(rows, "g", "t", "y", 3)
    assert "block" in _plan(parts)
    shown = lambda found: sorted((r.g or "", r["rank"], r.period, r.magnitude) for r in found)
    assert [x[:3] for x in shown(parts.collect())] == [x[:3] for x in shown(whole)] and len(whole) > 2
    assert np.allclose([x[3] for x in shown(parts.collect())], [x[3] for x in shown(whole)], rtol=1e-9)


def test_waves_of_a_long_series(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 4).selectExpr("id % 2 AS g", "id AS t", "CASE WHEN id % 50 > 0 THEN sin(2 * pi() * id / 40) END AS y")
    want = {r.t: (r.g, r.y, r.sin_0, r.cos_0, r.sin_1, r.cos_1) for r in periods.periodic_features(rows, "g", "t", "y", 2).collect()}
    monkeypatch.setattr(periods, "LONG", 100)
    monkeypatch.setattr(ranks, "ONE_TASK", 100)
    found = {r.t: (r.g, r.y, r.sin_0, r.cos_0, r.sin_1, r.cos_1) for r in periods.periodic_features(rows, "g", "t", "y", 2).collect()}
    same = lambda a, b: a == b or abs(a - b) < 1e-9 or (a != a and b is None)
    assert found.keys() == want.keys() and all(same(x, y) for t in want for x, y in zip(want[t], found[t]))


def test_other_classes_in_one_pass(spark):
    """Null classes, classes not asked for and a query whose class isn't among them."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.integers(0, 5, 2)], None if i % 9 == 4 else int(rng.integers(0, 5))) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    asked = df.where("id % 4 = 0")
    out = neighbours.nearest_other_class(df, asked, 3, id_column="id", vector="v", label="label", classes=[0, 1, 3])
    assert _plan(out).count("MapInPandas") == 1
    want = {}
    for i, v, own in rows:
        if i % 4 == 0 and own is not None:
            means = {}
            for c in (0, 1, 3):
                if c != own:
                    near = sorted(float(np.hypot(*np.subtract(v, w))) for j, w, y in rows if y == c and j != i)[:3]
                    means[c] = np.mean(near)
            best = min(means, key=lambda c: (round(means[c], 9), c))
            want[i] = (own, best, pytest.approx(means[best], abs=1e-9))
    found = {r.query: (r.own, r.label, r.distance) for r in out.collect()}
    assert found == want
