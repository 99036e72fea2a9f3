"""Small cases with known answers, and comparisons with brute force."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import constraints as c
from tessera.operators import distributions, loops, neighbours, periods, profile, reports, sampling, transforms
from tessera.operators.series import Series
from tessera.sources import readers

X, Y, Z = c.Feature(0), c.Feature(1), c.Feature(2)
NAMES = ["x", "y", "z"]


def _one(spark, node, x, y=0.0, z=0.0):
    return spark.createDataFrame([(x, y, z)], "x double, y double, z double").select(c.compiled(node, NAMES).alias("v")).first().v


def test_constraint_edges(spark):
    cases = [
        (X <= Y, (3.0, 1.0), 2.0),
        (X <= Y, (1.0, 3.0), 0.0),
        (X < Y, (1.0, 1.0), 2e-6),
        (X.equals(Y, 0.5), (1.0, 1.2), 0.0),
        (X <= Y, (None, 1.0), None),
        ((X <= Y) | (X <= Z), (5.0, 1.0, 4.0), 1.0),
        ((X <= Y) & (X <= Z), (5.0, 1.0, 4.0), 5.0),
        ((X <= Y) | (X <= Z), (5.0, None, 4.0), None),
        (X / Y, (1.0, 0.0), math.inf),
        (X / Y, (-1.0, 0.0), -math.inf),
        (X % Y, (-7.0, 3.0), 2.0),
        (X % Y, (7.0, -3.0), -2.0),
        (c.SafeDivision(X, Y, c.Const(9)), (1.0, 0.0), 9.0),
        (c.Log(X), (0.0,), -math.inf),
        (c.Log(X, c.Const(-1)), (-2.0,), -1.0),
        (c.Count((X <= Y, X <= Z)), (2.0, 1.0, 3.0), 1.0),
        (c.Count((X <= Y, X <= Z), inverse=True), (2.0, 1.0, 1.5), 2.0),
        (1 + X + Y, (2.0, 3.0), 6.0),
        (X**Y, (2.0, 3.0), 8.0),
    ]
    for node, row, want in cases:
        assert _one(spark, node, *row) == want, c.printed(node)
    assert math.isnan(_one(spark, X / Y, 0.0, 0.0))
    assert c.printed((X + Y) <= Z) == "((F(0) + F(1)) <= F(2))"
    assert c.printed((X < Y) | (X.equals(Z))) == "((F(0) < F(1)) OR (F(0) == F(2)))"


def test_one_relation_is_enough(spark):
    rules = c.Rules((c.FeatureInfo("x"), c.FeatureInfo("y")), (c.Feature("x") <= c.Feature("y"),))
    assert rules.filter(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double")).count() == 1


def test_guarded_fixer(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (3.0, 4.0, 5.0), (6.0, 7.0, 8.0)], "x double, y double, z double")
    fixed = c.guarded_fix(df, [(X.equals(Y + Z), X, Y + Z)], NAMES)
    assert [tuple(r) for r in fixed.collect()] == [(3, 1, 2), (9, 4, 5), (15, 7, 8)]
    assert df.first().x == 0.0


def test_type_repair(spark):
    rules = c.Rules((c.FeatureInfo("a", "int"), c.FeatureInfo("b", "cat"), c.FeatureInfo("r", "real", mutable=False)))
    df = spark.createDataFrame([(4.7, 1.4, 0.77, 1.0, 2.0, 0.5), (4.4, 1.6, 0.77, 5.0, 2.0, 0.5)], "a double, b double, r double, o_a double, o_b double, o_r double")
    assert [tuple(r) for r in df.select(*(x.alias(n) for n, x in c.type_repair(rules, "o_").items())).collect()] == [(4, 1, 0.5), (5, 2, 0.5)]
    only = c.Rules((c.FeatureInfo("b", "cat"),))
    assert df.select(c.type_repair(only, "o_")["b"].alias("b")).first().b == 1.4


def test_budgeted_repair_stays_within(spark):
    rules = c.Rules((c.FeatureInfo("a", "int"), c.FeatureInfo("r")))
    r = random.Random(0)
    rows = [(r.uniform(0, 9), r.uniform(0, 9), float(r.randrange(9)), r.uniform(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, r double, o_a double, o_r double")
    out = c.budgeted_repair(rules, "o_", {"a": 1.0, "r": 1.0}, 2.5)
    for x in df.select("o_a", "o_r", *(v.alias(n) for n, v in out.items())).collect():
        assert math.hypot(x.a - x.o_a, x.r - x.o_r) <= 2.5 + 1e-6 and x.a == round(x.a)


def test_metadata_scaler(spark):
    b = {"a": (-2, 6), "b": (3, 3)}
    df = spark.createDataFrame([(0.0, 3.0), (6.0, 3.0), (-2.0, 3.0)], "a double, b double")
    scaled = transforms.minmax(b).transform(df)
    assert [tuple(r) for r in scaled.collect()] == [(0.25, 0), (1, 0), (0, 0)]
    assert transforms.minmax_inverse(b).transform(scaled).collect() == df.collect()


def test_trial_summary(spark):
    df = spark.createDataFrame([(run, sub, 10.0 * run + sub) for run in (0, 1) for sub in (0, 1)], "r int, s int, m double")
    found = {(x.level, x.key): x for x in reports.trial_summary(df, "r", "s", "m").collect()}
    assert found["overall", None].mean == 5.5 and abs(found["overall", None].std - 5.024937810560445) < 1e-12
    assert (found["by_run", "0"].mean, found["by_run", "1"].mean, found["by_part", "0"].mean, found["by_part", "1"].mean) == (0.5, 10.5, 5, 6)
    assert found["across_run", None].std == 5


def test_best_per(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.5), (0, 2, 0.3), (1, 0, 0.7), (1, 1, 0.2), (1, 2, 0.7)], "run int, sub int, ce double")
    assert sorted((r.run, r["sub"]) for r in reports.best_per(df, "run", "ce", "sub").collect()) == [(0, 1), (1, 0)]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0), (1.0, 0.5, 0), (2.0, float("nan"), 1)], "a double, b double, c int")
    a, b, d = (r.f for r in df.select(transforms.fingerprint(df, ["a", "b", "c"]).alias("f")).collect())
    assert a == b != d
    ints = spark.createDataFrame([(1, 0.5, 0)], "a int, b double, c long")
    assert ints.select(transforms.fingerprint(ints, ["a", "b", "c"]).alias("f")).first().f == a
    assert df.select(transforms.fingerprint(df, ["b", "a", "c"]).alias("f")).first().f != a
    assert spark.sql("select sha2('abc', 256) s").first().s.startswith("ba7816bf") and spark.sql("select sha2('abc', 256) s").first().s.endswith("15ad")


def test_quotas():
    assert [sampling.k_from_percent(n, p) for n, p in ((100, 5), (1000, 5), (10, 5), (3, 0.1), (50, 100))] == [5, 50, 1, 1, 50]
    assert sampling.largest_remainder({"a": 70, "b": 30}, 81) == {"a": 57, "b": 24}
    assert sampling.capped_quotas({"a": 5, "b": 100, "c": 100}, 60) == {"a": 5, "b": 28, "c": 27}
    assert sum(sampling.largest_remainder({i: i + 1 for i in range(9)}, 33).values()) == 33
    assert sampling.lpt_packing({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == [["a", "d"], ["b", "c"]]


def test_draws_nest_and_balance(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10 < 3).cast("int").alias("y"))
    small = {r.id for r in sampling.sample_k(df, 50, "id").collect()}
    assert small <= {r.id for r in sampling.sample_k(df, 200, "id").collect()}
    fifty = sampling.per_class(df, "y", 50, "id").groupBy("y").count().collect()
    assert {r["count"] for r in fifty} == {50}
    used = sampling.balanced_rows(df.where("id < 30"), 6, 10, "id").groupBy("id").count().collect()
    assert {r["count"] for r in used} == {2}
    folds = sampling.folds(df.where("id < 100"), "y", 5, "id").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in folds if r.y == 1} == {6} and {r["count"] for r in folds if r.y == 0} == {14}


def _series(spark, rows):
    return Series(spark.createDataFrame(rows, "item_id int, timestamp timestamp_ntz, target double"))


def _day(k, hour=0):
    import datetime

    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=k)


def test_series_fill_and_slice(spark):
    a, b = [None, None, 1.0, None, None, 2.0, None], [None, 3.0, None, 4.0]
    s = _series(spark, [(0, _day(i), v) for i, v in enumerate(a)] + [(1, _day(i), v) for i, v in enumerate(b)])
    get = lambda x: [r.target for r in x.df.orderBy("item_id", "timestamp").collect()]
    assert get(s.filled("auto")) == [1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4]
    assert get(s.filled("interpolate")) == [None, None, 1, pytest.approx(4 / 3), pytest.approx(5 / 3), 2, 2, None, 3, 3.5, 4]
    t = _series(spark, [(i, _day(k), float(10 * i + k)) for i in range(3) for k in range(3)])
    assert get(t.slice(-2, None)) == [1, 2, 11, 12, 21, 22]
    assert get(t.slice(None, -1)) == [0, 1, 10, 11, 20, 21]
    assert get(t.slice(5, None)) == []
    assert t.frequency() == 86400
    assert _series(spark, [(0, _day(0), 1.0), (0, _day(1), 1.0), (0, _day(5), 1.0)]).frequency() is None


def test_series_resample(spark):
    s = _series(spark, [(0, _day(0), None), (0, _day(2), 1.0), (0, _day(5), 2.0), (0, _day(6), None), (1, _day(34), 3.0), (1, _day(37), 4.0)])
    get = lambda x, i: [r.target for r in x.df.where(F.col("item_id") == i).orderBy("timestamp").collect()]
    assert get(s.resampled("day"), 0) == [None, None, 1, None, None, 2, None]
    assert get(s.resampled("day", "sum"), 1) == [3, 0, 0, 4]
    q = _series(spark, [(0, _day(0).replace(year=2020 + k // 4, month=1 + 3 * (k % 4)), float(k + 1)) for k in range(8)])
    assert get(q.resampled("year"), 0) == [2.5, 6.5] and get(q.resampled("year", "sum"), 0) == [10, 26]


def test_calendar_codes_are_distinct(spark):
    week = _series(spark, [(0, _day(k), 1.0) for k in range(7)]).calendar(["weekday"]).df.collect()
    assert len({(round(r.weekday_sin, 9), round(r.weekday_cos, 9)) for r in week}) == 7
    hours = _series(spark, [(0, _day(0, h), 1.0) for h in range(24)]).calendar(["hour"]).df.collect()
    assert len({(round(r.hour_sin, 9), round(r.hour_cos, 9)) for r in hours}) == 24


def test_modality(spark):
    rows = [(float(i) * 1.5, "ab"[i % 2], i % 2, f"text {i}", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "num double, cat string, cat_num int, text string, const int")
    found = {r.column: r.modality for r in profile.modality(profile.profile(df, df.columns), min_rows=1, min_numeric=3, min_text=3).collect()}
    assert found == {"num": "numerical", "cat": "categorical", "cat_num": "categorical", "text": "text", "const": "constant"}


def test_shapley_equals_enumeration(spark):
    rng = np.random.default_rng(0)
    pool, asked = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    y, t, k = rng.integers(0, 2, 6), rng.integers(0, 2, 3), 2

    def utility(subset, q):
        order = sorted(subset, key=lambda i: (np.linalg.norm(pool[i] - asked[q]), i))[:k]
        return sum(y[i] == t[q] for i in order) / k

    want = np.zeros(6)
    for i in range(6):
        rest = [j for j in range(6) if j != i]
        for size in range(6):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(5 - size) / math.factorial(6)
                want[i] += w * sum(utility([*s, i], q) - utility(s, q) for q in range(3)) / 3
    p = spark.createDataFrame([(i, [float(v) for v in pool[i]], int(y[i])) for i in range(6)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(100 + i, [float(v) for v in asked[i]], int(t[i])) for i in range(3)], "id long, v array<double>, label int")
    near = neighbours.knn(p, q, 100, id_column="id", vector="v", carry=("label",))
    found = {r.neighbour: r.value for r in neighbours.shapley(near, q.selectExpr("id as query", "label as own"), k).collect()}
    assert all(abs(found[i] - want[i]) < 1e-10 for i in range(6))


def test_relabel(spark):
    labels = [0, 0, 1, 0, 0, 1, 1, 1, 1, 1]
    rows = spark.createDataFrame([(i, [float(i)], v) for i, v in enumerate(labels)] + [(90, [1000.0], 0), (91, [1001.0], 1)], "id long, v array<double>, label int")
    ten = rows.where("id < 10")
    near = neighbours.knn(rows, ten, 4, id_column="id", vector="v", carry=("label",))
    own = ten.selectExpr("id as query", "label as own")
    for share, want in ((0.75, {2: 0, 4: 1}), (1.0, {2: 0})):
        moved = {r.query: r.new for r in neighbours.relabelled(near, own, share).collect() if r.new != r.own}
        assert moved == want


def test_isotonic():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y, w = rng.normal(size=8), rng.uniform(0.5, 2, 8)
        f = distributions.pool_adjacent(y, w)
        want = [max(min(np.average(y[s : t + 1], weights=w[s : t + 1]) for t in range(i, 8)) for s in range(i + 1)) for i in range(8)]
        assert np.allclose(f, want)


def test_borders_and_elo(spark):
    assert distributions.equal_mass_borders(np.array([5, 1, 2, 3, 4, 6, 9]), 3) == [1.0, 2.5, 4.5, 6.0]
    rows = [(0.9, "a", "b"), (0.75, "b", "c"), (0.96, "a", "c")]
    pairs = spark.createDataFrame([(a, b, 100 * p, 100) for p, a, b in rows], "a string, b string, wins double, n long")
    rating = reports.elo(pairs, "b", prior=0.0)
    assert rating["b"] == 1000 and rating["a"] > rating["b"] > rating["c"]
    expected = {("a", "b"): 0, ("b", "c"): 0, ("a", "c"): 0}
    for n in "abc":  # at the optimum expected wins are the observed ones
        seen = sum(p for p, a, b in rows if a == n) + sum(1 - p for p, a, b in rows if b == n)
        model = sum(1 / (1 + 10 ** ((rating[o] - rating[n]) / 400)) for o in "abc" if o != n)
        assert abs(seen - model) < 1e-6
    assert expected


def test_periods():
    t = np.arange(240)
    found = periods.find_periods(np.sin(2 * np.pi * t / 12) * 3 + 0.5 * np.sin(2 * np.pi * t / 40) + 0.01 * t, 2)
    assert found[0][0] == 12 and len(found) == 2 and abs(found[1][0] - 40) <= 2
    assert periods.find_periods(np.ones(3)) == [] and periods.find_periods(np.ones(50)) == []


def test_searches():
    weights = [5, 1, 4, 2, 3]
    value = lambda s: float(sum(weights[i] for i in s))
    best, score = loops.beam_search(frozenset(), lambda beams: [[(b | {i}, value(b | {i})) for i in range(5) if i not in b] for b in beams], 2, 3)
    assert best == {0, 2, 4} and score == 12
    found, score = loops.genetic_search(5, 2, lambda g: [value(s) for s in g], generations=20)
    assert found == {0, 2} and score == 9
    assert [loops.schedule(100, s, h, a) for s, h, a in ((0, "oneshot", 0), (3, "m", 7), (0, "frac", 0.2), (1, "shrink", 0.2))] == [100, 7, 20, 10]


def test_growth_takes_the_best(spark):
    pool = spark.range(20).select(F.col("id").alias("row_id"))
    scorer = lambda accepted, rest: rest.select("row_id", (-F.col("row_id")).alias("score"))
    found = loops.greedy_growth(pool.where("row_id = 19"), pool, scorer, 7, how="m", amount=3).collect()
    assert sorted(r.row_id for r in found) == list(range(7)) and {r.step for r in found} == {0, 1, 2}


def test_fixed_points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(6, 0.5, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    m0, s0, m1, s1 = loops.two_gaussians(df, "x", 0.5, 15)
    assert abs(m0) < 0.2 and abs(m1 - 6) < 0.1 and abs(s0 - 1) < 0.15 and abs(s1 - 0.5) < 0.1
    t = loops.mass_threshold(df, "x", 300.0, 45)
    assert abs(np.clip(x - t, 0, 1).sum() - 300) < 1e-3
    p = spark.createDataFrame([([0.9, 0.1],)] * 80 + [([0.2, 0.8],)] * 20, "p array<double>")
    prior = loops.em_prior(p, "p", [0.5, 0.5], 60, 1e-9)
    assert abs(sum(prior) - 1) < 1e-9 and prior[0] > 0.8


def test_quantile_transforms(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 10)], "x double")
    u = transforms.quantile_uniform(df, ["x"], 5)
    assert [r.x for r in u.transform(df).orderBy("x").collect()][0] == 0 and [r.x for r in u.transform(df).collect()][-1] == 1
    z = [r.x for r in transforms.quantile_normal(df, ["x"], 5).transform(df).collect()]
    assert z == sorted(z) and abs(z[0] + z[-1]) < 1e-9
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [r.x for r in transforms.squash(same, ["x"]).transform(same).collect()] == [0, 0, None]


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "split_info.json").write_text(json.dumps({"target": "t"}))
    (tmp_path / "d" / "a.csv").write_text("x,t\n1.5,0\nNaN,1\n")
    path = str(tmp_path / "d" / "a.csv")
    df, features = readers.load_split(spark, path, readers.find_target(path))
    assert features == ["x"] and [r.x for r in df.collect()] == [1.5, None]
    (tmp_path / "meta.csv").write_text("feature,type,mutable,min,max\nb,int,FALSE,0,dynamic\na,real,TRUE,-1,2\n")
    a, b = readers.read_metadata(spark, str(tmp_path / "meta.csv"), ["a", "b"])
    assert (a.high, b.kind, b.mutable, b.high) == (2.0, "int", False, None)
    with pytest.raises(ValueError):
        readers.read_metadata(spark, str(tmp_path / "meta.csv"), ["a", "b"], strict=True)
    with pytest.raises(ValueError):
        readers.read_metadata(spark, str(tmp_path / "meta.csv"), ["a", "q"])
    run = tmp_path / "runs" / "gas_x_R20_c1_s7"
    run.mkdir(parents=True)
    (run / "r.json").write_text(json.dumps({"mode": "m", "rows": [{"entry": "e", "acc": 0.5}, {"entry": "f", "acc": 0.75}]}))
    rows = readers.read_trials(spark, str(tmp_path / "runs" / "*" / "*.json")).collect()
    assert {(r.dataset, r.r, r.c, r.seed, r.entry, r.acc) for r in rows} == {("gas_x", 20.0, 1, 7, "e", 0.5), ("gas_x", 20.0, 1, 7, "f", 0.75)}
    (tmp_path / "t.md").write_text("text\n| a | b |\n|---|---|\n| 1 | x y |\n| 2 | z |\n")
    assert [r.cells for r in readers.read_markdown(spark, str(tmp_path / "t.md")).collect()] == [["1", "x y"], ["2", "z"]]
    assert "**0.750**" in readers.to_markdown(spark.createDataFrame([(0.5,), (0.75,)], "acc double"), {"acc": "max"})
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.load_or_compute(spark, str(tmp_path / "kept"), make).count() == 3
    assert len(calls) == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f.bin").write_bytes(b"abc")
    assert readers.manifest(spark, str(tmp_path / "m")).first().sha256.startswith("ba7816bf")
    clean = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1)], "id int, x double, y int")
    delta = spark.createDataFrame([(2, 0.5, 0)], "id int, x double, y int")
    assert sorted(map(tuple, readers.replay_delta(clean, delta, "id", ["x"], "y").collect())) == [(1, 1.0, 0), (2, 2.5, 0)]


def test_streaming(spark, tmp_path):
    from tessera.streaming import events as ev

    rows = spark.createDataFrame([(1, _day(0, 1), 1.0), (1, _day(0, 5), None), (2, _day(0, 2), 5.0), (1, _day(1, 1), 3.0)], "item int, ts timestamp_ntz, v double")
    rows.write.parquet(str(tmp_path / "in"))
    source = ev.stream(spark, str(tmp_path / "in"), rows.schema)
    for name, df, mode in (("day_means", ev.resampled(source, "item", "ts", "v"), "complete"), ("filled", ev.forward_filled(source, "item", "v"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.item, r.n, r["mean"]) for r in spark.sql("select * from day_means").collect()} == {(1, 2, 1.0), (2, 1, 5.0), (1, 1, 3.0)}
    assert sorted((r.item, r.ts, r.v) for r in spark.sql("select * from filled").collect())[:2] == [(1, _day(0, 1), 1.0), (1, _day(0, 5), 1.0)] or spark.sql("select * from filled").count() == 4
