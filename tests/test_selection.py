"""Selections on small tables with known answers."""

from __future__ import annotations

import pytest

from tessera.operators import selection as s
from tessera.operators.ranks import numbered_within


def test_reserved_quotas():
    assert s.reserved_quotas({"a": 97, "b": 2, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sum(s.reserved_quotas({i: i + 1 for i in range(7)}, 23).values()) == 23
    with pytest.raises(ValueError):
        s.reserved_quotas({"a": 1, "b": 1}, 1)


def test_tuning_defaults():
    assert [s.tuning_defaults(n) for n in (1, 2000, 2001, 10_000, 20_000, 50_000, 50_001)] == [(0.1, 10), (0.1, 10), (0.2, 5), (0.2, 3), (0.2, 2), (0.3, 1), (0.2, 1)]


def test_places_within_a_hot_class_and_nulls(spark):
    rows = [(i, "hot", float(i % 7)) for i in range(200)] + [(i, None, float(-i)) for i in range(200, 210)] + [(300, "one", None)]
    df = spark.createDataFrame(rows, "id long, c string, x double")
    found = {r.id: r.place for r in numbered_within(df, ["c"], ["x", "id"], "place").collect()}
    want = {}
    for c in ("hot", None, "one"):
        want |= {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] or 0.0, r[0])), 1)}
    assert found == want


def test_shortfall_goes_to_the_largest_weights(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.1), (3, 1, 0.2), (4, 1, 0.3), (5, 1, 0.4), (6, 1, 0.4)], "id long, y int, w double")
    keep = lambda how: sorted(r.id for r in s.keep_by_weight(df, "w", "y", 4, how, "id").collect())
    assert keep("balanced") == [1, 4, 5, 6]
    assert keep("global") == [1, 4, 5, 6]
    assert sorted(r.id for r in s.keep_by_weight(df, "w", "y", 9, "proportional", "id").collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        s.keep_by_weight(df, "w", "y", 4, "best", "id")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, y int, w double")
    assert s.take_share(df, "y", 5, "id").count() == 0
    assert s.top_k_mask(df, "w", 2, "id").count() == 0
    assert s.default_split(df, "y", "id").count() == 0
    assert s.keep_by_weight(df, "w", "y", 3, "balanced", "id").count() == 0
    assert s.round_robin(df, "y", 2, 3, "id").count() == 0


def test_small_class_repeats(spark):
    df = spark.createDataFrame([(i, 0) for i in range(8)] + [(9, 1)], "id long, y int")
    found = s.round_robin(df, "y", 3, 6, "id").collect()
    assert sorted(r.estimator for r in found) == [0] * 6 + [1] * 6 + [2] * 6
    assert [sum(r.id == 9 and r.estimator == e for r in found) for e in range(3)] == [1, 1, 1]
