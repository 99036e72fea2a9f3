"""Null scores, classes and vectors, ties of whole tables, infinities and names in use."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import confident as cf
from tessera.operators import ranks, sampling
from tessera.operators import schema as sc
from tessera.operators import selection as sel
from tessera.operators import steps as st


def _scores(spark):
    rows = [(i, None if i < 3 else float(i), None if i in (1, 4) else f"c{i % 2}", None if i == 2 else [float(i), 0.0]) for i in range(10)]
    return spark.createDataFrame(rows, "id long, score double, cls string, x array<double>")


def _ids(df, where="true"):
    return sorted(r.id for r in df.where(where).collect())


def test_nulls_come_last(spark):
    df = _scores(spark)
    assert _ids(sel.one_shot(df, "score", "cls", "top", 0.3, "id"), "kept") == [7, 8, 9]
    assert _ids(sel.one_shot(df, "score", "cls", "thr", 6.5, "id"), "not kept") == [0, 1, 2, 3, 4, 5, 6]
    assert not set(_ids(sel.one_shot(df, "score", "cls", "cls", 0.5, "id"), "kept")) & {0, 2}
    assert _ids(sel.keep_by_weight(df, "score", "cls", 4, "global", "id")) == [6, 7, 8, 9]
    assert len(_ids(sel.keep_by_weight(df, "score", "cls", 6, "proportional", "id"))) == 6
    assert 2 not in _ids(sel.local_draw(df, "cls", "x", [2.0, 0.0], 5, "id"))


def test_null_classes(spark):
    df = _scores(spark)
    parts = {r.part: r.n for r in sel.default_split(df, "cls", "id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 2, "val": 2, "train": 6}
    assert sampling.exact_split(df, "cls", 10, "id").count() == 10
    assert sel.imbalanced_draw(df, "cls", 6, "c1", 1, "id").count() == 6
    assert sum(sel.reserved_quotas({None: 2, "a": 2}, 3).values()) == 3
    assert sampling.capped_quotas({None: 2, "a": 5}, 6) == {None: 2, "a": 4}
    with pytest.raises(ValueError, match="classes"):
        sampling.class_counts(spark.range(sampling.MOST_CLASSES + 1), "id")


def test_ties_are_dealt_out(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        for score in (F.lit(0.5), (F.col("id") % 2).cast("double"), F.when(F.col("id") % 3 > 0, 1.0)):
            df = spark.range(4000).withColumn("s", score)
            rows = df.withColumn("r", ranks.ranged(df, ["s", "id"])).groupBy("r").count().collect()
            # a value of a third of the rows counts as several ranges; nulls are one value
            assert max(r["count"] for r in rows) <= 1000
            placed = ranks.numbered(df, ["s", "id"], "place").orderBy("place").collect()
            want = sorted(range(4000), key=lambda i: (placed_key(df_rows(score), i), i))
            assert [r.id for r in placed] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def df_rows(score):
    text = str(score)
    return "third" if "CASE" in text else "half" if "%" in text else "one"


def placed_key(kind, i):
    return 0 if kind == "one" else i % 2 if kind == "half" else int(i % 3 > 0)


def test_infinite_values_stay(spark):
    rows = [(i, float(i)) for i in range(100)] + [(100, math.inf), (101, -math.inf), (102, None)]
    df = spark.createDataFrame(rows, "id long, x double")
    for preset in ("kdi_uni", "kdi", "power_box", "power"):
        out = {r.id: r.x for r in st.PRESETS[preset](df, ["x"]).transform(df).collect()}
        assert out[100] == math.inf and out[101] == -math.inf and out[102] is None
        finite = [out[i] for i in range(100)]
        assert finite == sorted(finite) and len(set(finite)) > 90, preset


def test_quantile_presets_differ(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=5000))], "id long, x double")
    fitted = {p: st.PRESETS[p](df, ["x"]) for p in ("quantile_uni_coarse", "quantile_uni", "quantile_uni_fine", "quantile_uni_extrapolate")}
    assert [len(f.state["x"]) for f in fitted.values()] == [500, 1000, 5000, 1000]
    x = np.array([v[1] for v in df.collect()])
    for name in ("quantile_uni_coarse", "quantile_uni_fine"):
        k = len(fitted[name].state["x"])
        q = np.percentile(x, np.linspace(0, 100, k))
        assert np.allclose(fitted[name].state["x"], q, rtol=0, atol=1e-12)
        own = np.array([v.x for v in fitted[name].transform(df).orderBy("id").collect()])
        assert np.allclose(own, (np.interp(x, q, np.linspace(0, 1, k)) - np.interp(-x, -q[::-1], -np.linspace(0, 1, k)[::-1])) / 2, atol=1e-12)
    far = spark.createDataFrame([(0, 100.0), (1, -100.0), (2, None)], "id long, x double")
    assert [v.x for v in fitted["quantile_uni_extrapolate"].transform(far).orderBy("id").collect()] == [2.0, -1.0, None]


def test_shapes(spark):
    r = np.random.default_rng(2)
    left = -r.exponential(size=2000)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(r.normal(size=2000), left, r.exponential(size=2000) + 0.1, np.where(np.arange(2000) % 2, 1.0, -1.0) * (3 + r.random(2000)))], "n double, l double, p double, two double")
    # left-skewed columns aren't skewed; two heaps are neither normal nor skewed
    tags = sc.shape_tags(df, ["n", "l", "p", "two"])
    assert tags["n"] == "normal" and tags["l"] == "other" and tags["two"] == "other"
    assert sc.normality(np.array([1.0, 1.0])) == 1.0
    known = sc.normality(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert abs(known - 0.79) < 0.01  # a published example


def test_appended_names_are_free(spark):
    df = spark.createDataFrame([(0.5, "kept"), (0.1, "kept")], "x double, x_exp string")
    out, schema, ancestors = st.reshaped(df, st.Schema((("x", st.NUMERICAL),)), "exp", append=True)
    assert {r.x_exp for r in out.collect()} == {"kept"} and schema.names == ["x", "x_exp_1"] and ancestors == {"x_exp_1": "x"}


def test_confident_small(spark):
    assert cf.calibrated([[8, 2], [0, 0]], [10, 4]) == [[8, 2], [0, 4]]
    assert sum(cf.calibrated([[1, 5, 5], [0, 3, 0], [0, 0, 0]], [12, 3, 0])[0]) == 12
    rows = [(i, "ab"[i % 2] if i != 9 else None, [0.9, 0.1] if (i % 2 == 0) != (i == 4) else [0.2, 0.8]) for i in range(12)] + [(12, "a", None)]
    df = spark.createDataFrame(rows, "id long, y string, probs array<double>")
    found = {r.id: r for r in cf.issues(df, "y", ["a", "b"], "id").collect()}
    assert len(found) == 13 and not found[9].issue and not found[12].issue
    assert [i for i, r in found.items() if r.issue] == [4]
    model = lambda learned, asked: asked.select("id", F.array(F.lit(learned.count() / 100), F.lit(0.5)).alias("probs"))
    dealt = cf.dealt(spark.range(10), 3, "id")
    out = cf.out_of_fold(dealt, model, 3, "id").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.first(F.get("probs", F.lit(0)) / F.get("probs", F.lit(1))), 6).alias("p")).orderBy("fold").collect()
    assert [(r.n, r.p) for r in out] == [(4, 0.12), (3, 0.14), (3, 0.14)]
    assert cf.classes_of(df, "y") == ["a", "b"]


def test_gaussian_without_a_class_in_other_folds(spark):
    rows = [(0, 0, "a", [1.0]), (1, 1, "a", [1.1]), (2, 1, "a", [0.9]), (3, 0, "b", [5.0]), (4, 1, None, [5.0]), (5, 0, "a", None)]
    df = spark.createDataFrame(rows, "id long, fold int, y string, x array<double>")
    found = {r.id: r.probs for r in cf.gaussian_out_of_fold(df, "x", "y", 1, ["a", "b"], "id").collect()}
    assert found[3][0] > 0.99 and found[4][1] > 0.99 and found[5] is None
