"""Inputs derived from the driver's tables; each has the same formula as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import geo


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


TRACK_SQL = """track AS (
  SELECT user_id AS grp, ts, event_id AS fid,
         CAST(event_id * 37 % 1000 AS DOUBLE) / 10 AS x, value AS y
  FROM events)"""


def track_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("grp"),
        "ts",
        F.col("event_id").alias("fid"),
        ((F.col("event_id") * 37 % 1000).cast("double") / 10).alias("x"),
        F.col("value").alias("y"),
    )


SMOOTH_SQL = """numbered AS (
  SELECT user_id AS grp, event_id AS fid,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
smooth AS (
  SELECT grp, fid, CAST(rn AS DOUBLE) * 2 AS x,
         CASE WHEN (rn // 25) % 2 = 0 THEN CAST(rn % 25 AS DOUBLE) ELSE CAST(24 - rn % 25 AS DOUBLE) END AS y
  FROM numbered)"""


def smooth_points(spark: SparkSession, sf: str) -> DataFrame:
    from fieldspark.plans.ordered import Sequence

    e = table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("fid"))
    d = Sequence(e, ["grp"], ["fid"]).number("rn").result()
    rn = F.col("rn")
    up = F.floor(rn / 25) % 2 == 0
    return d.select(
        "grp",
        "fid",
        (rn.cast("double") * 2).alias("x"),
        F.when(up, (rn % 25).cast("double")).otherwise((24 - rn % 25).cast("double")).alias("y"),
    )


POINTS_A_SQL = """pa AS (
  SELECT s_suppkey AS fid, s_nationkey AS k, s_acctbal / 100 AS x, CAST(s_suppkey AS DOUBLE) AS y
  FROM supplier)"""
POINTS_B_SQL = """pb AS (
  SELECT c_custkey AS fid, c_nationkey AS k, c_acctbal / 100 AS x, CAST(c_custkey AS DOUBLE) AS y
  FROM customer)"""


def points_a(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("fid"),
        F.col("s_nationkey").alias("k"),
        geo.point(F.col("s_acctbal") / 100, F.col("s_suppkey")).alias("geom"),
    )


def points_b(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("fid"),
        F.col("c_nationkey").alias("k"),
        geo.point(F.col("c_acctbal") / 100, F.col("c_custkey")).alias("geom"),
    )


PIXELS_SQL = """pixels AS (
  SELECT l_linenumber AS raster_id, 1 AS band, CAST(l_orderkey % 64 AS INTEGER) AS row,
         CAST(l_partkey % 64 AS INTEGER) AS col, avg(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""


def pixels(spark: SparkSession, sf: str, value: str = "l_quantity") -> DataFrame:
    li = table(spark, sf, "lineitem")
    return (
        li.groupBy(
            F.col("l_linenumber").alias("raster_id"),
            (F.col("l_orderkey") % 64).cast("int").alias("row"),
            (F.col("l_partkey") % 64).cast("int").alias("col"),
        )
        .agg(F.avg(value).alias("value"))
        .select("raster_id", F.lit(1).alias("band"), "row", "col", "value")
    )


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """One 64 x 64 grid per raster id, all with the same extent."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_linenumber").alias("raster_id")).distinct().select(
        "raster_id",
        F.lit(0.0).alias("x0"),
        F.lit(64.0).alias("y0"),
        F.lit(1.0).alias("dx"),
        F.lit(1.0).alias("dy"),
        F.lit(64).alias("ncols"),
        F.lit(64).alias("nrows"),
        F.lit(32722).alias("srid"),
        F.lit(-9999.0).alias("nodata"),
    )


def shifted_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Grids with origins of their own; raster 4 has cells of twice the size."""
    k = F.col("raster_id")
    size = F.when(k == 4, 2.0).otherwise(1.0)
    return grids(spark, sf).withColumns(
        {"x0": 2.0 * (k % 3), "y0": 64.0 - (k % 2), "dx": size, "dy": size}
    )


SHIFTED_SQL = """g AS (
  SELECT k AS raster_id, 2.0 * (k % 3) AS x0, 64.0 - (k % 2) AS y0, CASE WHEN k = 4 THEN 2.0 ELSE 1.0 END AS d
  FROM (SELECT DISTINCT l_linenumber AS k FROM lineitem))"""


def two_bands(px: DataFrame) -> DataFrame:
    """The pixels with a second band of other values."""
    return px.unionByName(px.withColumns({"band": F.lit(2), "value": F.col("value") + 100.0}))
