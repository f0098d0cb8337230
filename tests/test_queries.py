"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from tessera import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) <= 2e-6).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
