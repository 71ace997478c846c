"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

import workloads
from check_oracle import TABLES, rows

QUERIES, ORACLES = workloads.load()


@pytest.fixture(scope="module")
def con(request):
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, cur.fetchall())
