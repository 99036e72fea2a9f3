"""The corpus queries that SQL can express give the rows of their SQL."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLES[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    at = [list(rel.columns).index(n) for n in names]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
