"""Every registered query of the dialect against its SQL in another engine."""

from __future__ import annotations

import os

import pytest

from larkspur import catalog_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in catalog_queries.TABLES:
        con.execute(f"CREATE VIEW {t.lower()} AS SELECT * FROM read_parquet('{SF}/{t.lower()}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    got = duck.execute(catalog_queries.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


def test_all_have_an_oracle():
    assert set(catalog_queries.QUERIES) == set(catalog_queries.ORACLE_SQL)
