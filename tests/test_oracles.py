"""Every query with an oracle gives the rows that its SQL gives."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else repr(round(float(x), 8) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([_plain(v) for v in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return repr(round(float(x), 8))
    return str(x)


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    found = sorted(tuple(_plain(r[i]) for i in order) for r in df.collect())
    rel = duck.sql(catalog.oracles()[name])
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    assert len(found) == len(want)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs(spark, name):
    """Has rows; what they hold is compared with numpy or brute force in a test of its operator."""
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1
