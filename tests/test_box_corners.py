"""Boxes of the spatial queries have the corners of their SQL to the last bit."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import workloads
from check_oracle import rows

QUERIES, ORACLES = workloads.load()
# Balances of a supplier and of a customer on the right side of its box: rounding puts the side a bit left or right of it.
ON_SIDE = [(24, -25.89, 423.81), (17, -22.19, 227.51), (19, -0.97, 448.73), (12, -4.70, 245.00), (4, -4.90, 444.80)]


@pytest.fixture
def on_side(tmp_path):
    near = [(40 * i, n, s) for i, (n, s, _) in enumerate(ON_SIDE)]
    # A second supplier whose left side is the right one of the first.
    near += [(1001 + 40 * i, n, round(s + 100 * (n % 5) + 50, 2)) for i, (n, s, _) in enumerate(ON_SIDE)]
    s = {"s_suppkey": [r[0] for r in near], "s_nationkey": pa.array([r[1] for r in near], pa.int32()), "s_acctbal": [r[2] for r in near]}
    c = {"c_custkey": [47 * i for i in range(len(ON_SIDE))], "c_acctbal": [r[2] for r in ON_SIDE]}
    pq.write_table(pa.table(s), tmp_path / "supplier.parquet")
    pq.write_table(pa.table(c), tmp_path / "customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["spatial_join", "box_pairs", "extract_by_location", "reverse_geocode", "spatial_join_sizes"])
def test_points_on_a_side(spark, on_side, name):
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{on_side}/{t}.parquet'")
    df = QUERIES[name](spark, on_side)
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())
