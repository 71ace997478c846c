"""Strip methods on hand-made traces, and equal results however a group is cut."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators.strip_scans import StripSettings, segment_strips_full, segment_strips_score
from fieldspark.operators.tracks import segment_strips
from fieldspark.plans.stateful import scan


def _corner(n=30):
    """North-east for n points, then south-east for n points."""
    pts = [(i, 4.0 * i, 4.0 * i) for i in range(n)]
    return pts + [(n + i, 4.0 * (n + i), 4.0 * (n - 2 - i)) for i in range(n)]


def _frame(spark, pts, group="a"):
    rows = [(group, i, float(i), x, y) for i, x, y in pts]
    return spark.createDataFrame(rows, "g string, fid long, t double, x double, y double")


def _shots(df):
    return {r.fid: r.shot_id for r in df.collect()}


def test_simple_corner_and_gap(spark):
    s = _shots(segment_strips(_frame(spark, _corner()), ["g"], id_col="fid", min_points=10))
    assert s[0] == "1" and s[59] != "1" and s[59] != "0"
    pts = [(i, 0.0, 5.0 * i + (500 if i >= 25 else 0)) for i in range(50)]
    rows = {r.fid: r for r in segment_strips(_frame(spark, pts), ["g"], id_col="fid", max_distance=150.0).collect()}
    assert rows[24].shot_id == "1" and rows[25].shot_id == "2" and rows[25].seg_type == "break_distance"
    assert rows[0].seg_type == "start" and rows[49].seg_type == "end"


def test_score_method(spark):
    s = _shots(segment_strips_score(_frame(spark, _corner()), ["g"], id_col="fid", min_points=10))
    assert s[5] == "1" and s[55] == "2"
    straight = [(i, 0.0, 5.0 * i) for i in range(50)]
    rows = segment_strips_score(_frame(spark, straight), ["g"], id_col="fid").collect()
    assert {r.shot_id for r in rows} == {"1"} and {r.score for r in rows} == {0}


def test_full_method(spark):
    rows = {r.fid: r for r in segment_strips_full(_frame(spark, _corner()), ["g"], id_col="fid", settings=StripSettings(min_points=10)).collect()}
    assert rows[5].shot_id == "1" and rows[55].shot_id == "2" and rows[55].shot_valid == 1
    few = _frame(spark, _corner(5))
    assert {r.shot_id for r in segment_strips_full(few, ["g"], id_col="fid", recap=False).collect()} == {"0"}


@pytest.mark.parametrize("method", ["simple", "score", "full"])
def test_cut_equals_whole(spark, sf, method):
    """One group with all rows, cut into pieces of a few hundred."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    # Legs of 40 points with a jitter that changes from leg to leg.
    leg = F.floor(i / 40)
    df = e.select(
        F.lit("a").alias("g"),
        i.alias("fid"),
        i.cast("double").alias("t"),
        (i % 40 * F.cos(leg * 1.3) * 5 + leg * 30 + F.col("value") % 1).alias("x"),
        (i % 40 * F.sin(leg * 1.3) * 5 + (i * 7 % 11) / 20).alias("y"),
    )

    def run(cut):
        if method == "simple":
            d = segment_strips(df, ["g"], id_col="fid", ts="t", min_points=8, cut=cut)
        elif method == "score":
            d = segment_strips_score(df, ["g"], id_col="fid", ts="t", min_points=8, cut=cut)
        else:
            d = segment_strips_full(df, ["g"], id_col="fid", ts="t", settings=StripSettings(min_points=8), cut=cut)
        return sorted((r.fid, r.shot_id, r.shot_valid, r.seg_type, r.score) for r in d.collect())

    whole = run(False)
    spark.conf.set("spark.fieldspark.maxGroupRows", "400")
    try:
        assert run(True) == whole
    finally:
        spark.conf.unset("spark.fieldspark.maxGroupRows")
    assert len({w[1] for w in whole}) > 2


def test_small_groups_are_scanned_together(spark):
    """One look at the rows serves many groups, and every group begins anew."""
    calls = spark.sparkContext.accumulator(0)

    def kernel(rows, starts):
        calls.add(1)
        fids = rows["fid"].tolist()

        def scan_one(first, last, begin, end, state):
            return [(i, fids[i], i - first) for i in range(begin, end)], ""

        return scan_one

    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("fid")).coalesce(1)
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g") + F.lit(2**60)))
    rows = scan(df, ["g"], ["fid"], kernel, "fid bigint, at int", reach=1, cut=False).collect()
    assert len(rows) == 4000
    assert all(r.at == r.fid // 1000 and r.g == (2**60 + r.fid % 1000 if r.fid % 1000 else None) for r in rows)
    assert calls.value <= int(spark.conf.get("spark.sql.shuffle.partitions"))
