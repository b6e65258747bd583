"""Every registered query of the engine against DuckDB on the smallest tables."""

import os

import pytest
from basetrack import entrypoints

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entrypoints.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entrypoints.queries()[name](spark, SF)
    want = duck.sql(entrypoints.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_points():
    import __spark_entry__

    assert set(entrypoints.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
