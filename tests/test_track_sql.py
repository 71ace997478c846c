"""Tracks that go back and forth: the sum of two opposite directions is nothing but last bits."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from check_oracle import rows
from workloads import tracks_q


def _events(spark, folder, values):
    start = datetime(2024, 1, 1)
    # The place of a point is event_id * 37 % 1000 / 10.
    data = [(e, start + timedelta(seconds=i), u, float(v)) for u, i, e, v in values]
    path = f"{folder}/events.parquet"
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, value double").write.parquet(path)
    return str(folder), path


def _same(spark, folder, path, name):
    query, sql = tracks_q.REGISTRY[name]
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(sql)
    df = query(spark, folder)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["segment_strips", "instant_azimuth"])
def test_opposite_directions(spark, tmp_path, name):
    rnd = random.Random(3)
    values = []
    for user in range(300):
        ends = [(rnd.randrange(1000), round(rnd.uniform(0, 150), 2)) for _ in range(2)]
        # Each row has an id of its own at the place of one of two ends.
        values += [(user, i, (user * 40 + i) * 1000 + ends[i % 2][0], ends[i % 2][1]) for i in range(30)]
    _same(spark, *_events(spark, tmp_path, values), name)


def test_gap_at_the_limit(spark, tmp_path):
    """A step of 63 is not over 0.7 times 90."""
    _same(spark, *_events(spark, tmp_path, [(1, i, i * 1000, 63.0 * i) for i in range(8)]), "segment_strips")
