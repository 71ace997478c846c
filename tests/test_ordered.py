"""Cutting a hot group into pieces must not change any row."""

from pyspark.sql import functions as F

from fieldspark.functions import angles
from fieldspark.plans.ordered import Sequence
from fieldspark.plans.quantiles import order_statistics


def _track(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    # Two thirds of the rows fall into one group.
    return ev.select(
        F.when(F.col("user_id") % 3 > 0, -1).otherwise(F.col("user_id")).alias("g"),
        "ts",
        "event_id",
        "value",
    )


def _run(df, cut, limit):
    spark = df.sparkSession
    spark.conf.set("spark.fieldspark.maxGroupRows", str(limit))
    seq = Sequence(df, ["g"], ["ts", "event_id"], cut=cut)

    def body(d, w):
        return d.withColumn("prev", F.lag("value").over(w)).withColumn(
            "near", F.round(F.sum("value").over(w.rowsBetween(-3, 4)), 6)
        )

    seq.bounded(5, body)
    seq.running(s=F.when(F.col("value") > 50, 1).otherwise(0)).number("rn").total("n")
    seq.last_before("lv", F.when(F.col("event_id") % 7 == 0, F.col("event_id")))
    spark.conf.unset("spark.fieldspark.maxGroupRows")
    return sorted(seq.result().collect(), key=lambda r: r.event_id)


def test_cut_equals_whole(spark, sf):
    df = _track(spark, sf)
    whole = _run(df, None, 10**6)
    for limit in (400, 60, 4):
        assert _run(df, None, limit) == whole


def test_order_statistics(spark, sf):
    df = _track(spark, sf)
    q = {"p5": 0.05, "med": 0.5, "p95": 0.95}
    for mode in ("linear", "floor"):
        a = {r.g: r for r in order_statistics(df, ["g"], "value", q, mode, cut=False).collect()}
        spark.conf.set("spark.fieldspark.maxGroupRows", "50")
        b = {r.g: r for r in order_statistics(df, ["g"], "value", q, mode, cut=True).collect()}
        spark.conf.unset("spark.fieldspark.maxGroupRows")
        assert a.keys() == b.keys()
        for k in a:
            for n in q:
                assert abs(a[k][n] - b[k][n]) < 1e-9


def test_angle_helpers(spark):
    df = spark.createDataFrame([(350.0, 1.0), (10.0, 3.0), (None, 5.0)], "a double, w double")
    r = df.agg(
        angles.circular_mean(F.col("a")).alias("m"),
        angles.circular_mean_w(F.col("a"), F.col("w")).alias("mw"),
        angles.axial_var(F.col("a")).alias("v"),
    ).first()
    assert min(r.m, 360 - r.m) < 1e-9 and 5.0 < r.mw < 5.1 and 0 < r.v < 0.1
