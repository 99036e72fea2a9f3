"""Schemas, presets and assessments on small tables with known answers."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import assessment as a
from tessera.operators import steps as st

S = st.Schema((("x", st.NUMERICAL), ("c", st.CATEGORICAL), ("z", st.NUMERICAL)))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, float(x), "abc"[i % 3], float(z)) for i, (x, z) in enumerate(zip(rng.normal(size=240), np.exp(rng.normal(size=240)), strict=True))]
    data += [(240, None, None, None), (241, None, "b", 1.0)]
    return spark.createDataFrame(data, "id long, x double, c string, z double")


def test_schema_algebra():
    assert S.append(st.TEXT, ["x", "y"]).names == ["x", "c", "z", "x_1", "y"]
    assert S.slice([2, 0]).names == ["z", "x"]
    assert S.remove([1]).names == ["x", "z"]
    assert S.merged([1], st.Schema((("c", st.NUMERICAL),))).of(st.NUMERICAL) == ["x", "c", "z"]
    with pytest.raises(ValueError):
        S.merged([0, 1], st.Schema((("c", st.NUMERICAL),)))


@pytest.mark.parametrize("name", ["power", "power_box", "quantile_norm", "quantile_uni_extrapolate", "squashing_scaler_max10", "robust", "adaptive", "kdi_uni", "kdi_alpha_0.3", "none"])
def test_presets_keep_order_and_nulls(rows, name):
    df, schema, ancestors = st.reshaped(rows, S, name)
    assert df.columns == rows.columns and schema.names == S.names and ancestors == {"x": "x", "z": "z"}
    before, after = ({r.id: r for r in d.collect()} for d in (rows, df))
    for c in ("x", "z"):
        ids = sorted((i for i in before if before[i][c] is not None), key=lambda i: before[i][c])
        assert [i for i in after if after[i][c] is None] == [i for i in before if before[i][c] is None]
        values = [after[i][c] for i in ids]
        assert all(p <= q + 1e-9 for p, q in zip(values, values[1:], strict=False))
        assert np.isfinite(values).all() and values[0] < values[-1]


def test_two_columns_each(rows):
    df, schema, ancestors = st.reshaped(rows, S, "norm_and_kdi")
    assert schema.names == ["x", "c", "z", "x_kdi", "z_kdi"] and ancestors["z_kdi"] == "z"
    assert df.agg({"x_kdi": "max"}).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        st.reshaped(rows, S, "best")


def test_clean_keeps_what_it_should(spark):
    df = spark.createDataFrame([(1, "NA", "2.5", float("inf")), (2, "b", "x", float("nan")), (3, "a", None, 1.0), (4, None, "1", None)], "id long, c string, t string, z double")
    out = st.clean(df, st.Schema((("c", st.CATEGORICAL), ("t", st.NUMERICAL), ("z", st.NUMERICAL))), ["NA"])
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, 2.5, float("inf")), (2, 1.0, None, None), (3, 0.0, None, 1.0), (4, None, 1.0, None)]


def test_pipeline_applies_what_it_fitted(spark, rows):
    from tessera.operators import transforms as t

    p = st.ModalPipeline([("fill", (st.NUMERICAL,), lambda d, c: t.imputed(d, c, "mean")), ("none", (st.DATE,), lambda d, c: 1 / 0), ("scale", (st.NUMERICAL,), t.standard)])
    fitted = {r.id: r.x for r in p.fit_transform(rows, S).collect()}
    one = p.transform(rows.where("id = 7")).first()
    assert one.x == pytest.approx(fitted[7])


def test_configurations():
    found = a.configurations([[0, 1], [1, 0]], [None], ["none", "power"], 3)
    assert len(found) == 3 and found[0][:2] == found[1][:2] and found[0][2] == "none"


def test_repair_of_no_gap_is_unstable(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5, 0.5, 0.5), (0.6, 0.5, 0.7), (0.6, 0.5, 0.505)], "m double, p double, o double")
    share, unstable = a.repair_share(F.col("m"), F.col("p"), F.col("o"))
    found = df.select(share.alias("s"), unstable.alias("u")).collect()
    assert found[0].s is None and found[0].u and found[1].s == pytest.approx(0.5) and not found[1].u and found[2].u


def test_unknown_metrics_raise(spark):
    with pytest.raises(ValueError):
        a.scored(spark.createDataFrame([(1, [0.2, 0.8])], "y int, p array<double>"), ["best"], "p", "y")


def test_rarest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert a.least_common(df, "c") == 1
    assert a.least_common(df.where("c = 'x'"), "c") == 0
