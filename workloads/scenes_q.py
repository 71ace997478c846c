"""Scene catalogue derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import scenes
from workloads.inputs import table, with_sql


def catalog(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    x, y = (k % 360 - 180).cast("double"), (k % 170 - 85).cast("double")
    even = F.map_from_arrays(F.array(F.lit("red"), F.lit("B03"), F.lit("blue")), F.array(F.lit("r"), F.lit("g"), F.lit("b")))
    odd = F.map_from_arrays(F.array(F.lit("B04"), F.lit("green")), F.array(F.lit("r4"), F.lit("g4")))
    return o.select(
        k.cast("string").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderdate").alias("datetime"),
        F.concat(F.lit("T"), k % 50).alias("tile"),
        F.lit("SENTINEL").alias("platform"),
        F.when(k % 9 != 0, (F.col("o_custkey") % 100).cast("double")).alias("clouds"),
        F.when(k % 2 == 0, even).otherwise(odd).alias("assets"),
        F.struct(x.alias("xmin"), y.alias("ymin"), (x + 2).alias("xmax"), (y + 2).alias("ymax")).alias("bbox"),
        F.when(k % 3 == 0, 32722).otherwise(32723).alias("epsg"),
    )


CATALOG_SQL = """cat AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderdate AS dt, 'T' || (o_orderkey%50) AS tile,
 CASE WHEN o_orderkey%9<>0 THEN o_custkey%100 END AS clouds, o_orderkey%360-180 AS x, o_orderkey%170-85 AS y FROM orders)"""


def search_scenes(spark, sf):
    d = scenes.search_scenes(catalog(spark, sf), (-60.0, -35.0, -30.0, 5.0), "1995-01-01", "1996-12-31", 40.0, 200)
    return d.select("id", "date", "clouds")


def search_all(spark, sf):
    d = scenes.search_scenes(catalog(spark, sf), (-60.0, -35.0, -30.0, 5.0), "1995-01-01", "1996-12-31", 40.0, None)
    return d.select("id")


_WHERE = "x <= -30 AND x+2 >= -60 AND y <= 5 AND y+2 >= -35 AND dt >= '1995-01-01' AND dt < '1997-01-01' AND coalesce(clouds,0) <= 40"


def scene_products(spark, sf):
    c = catalog(spark, sf)
    done = c.filter(F.col("id").cast("bigint") % 4 == 0).select(
        F.concat("date", F.lit("_"), "tile", F.lit("_SENTINEL/"), "date", F.lit("_"), "tile", F.lit("_SENTINEL_B04_refl.tif")).alias("path")
    )
    d = scenes.plan_scene_products(c, ["RGB", "SCL"], done, epsg=32722)
    return d.select("id", "band", "asset", "href", "path", "to_reflectance", "reproject")


_BASE = "date || '_' || tile || '_SENTINEL'"
PRODUCTS_SQL = with_sql(
    [
        CATALOG_SQL,
        f"done AS (SELECT DISTINCT {_BASE} || '/' || {_BASE} || '_B04_refl.tif' AS path FROM cat WHERE k%4=0)",
        f"""p AS (SELECT id, k, band, {_BASE} || '/' || {_BASE} || '_' || band || CASE WHEN band = 'SCL' THEN '.tif' ELSE '_refl.tif' END AS path
 FROM cat, (VALUES ('B04'),('B03'),('B02'),('SCL')) b(band))""",
    ],
    """SELECT id, band, CASE WHEN band='SCL' THEN 'SCL' WHEN k%2=0 THEN CASE band WHEN 'B04' THEN 'red' WHEN 'B03' THEN 'B03' ELSE 'blue' END
 ELSE CASE band WHEN 'B04' THEN 'B04' WHEN 'B03' THEN 'green' ELSE 'B02' END END AS asset,
 CASE WHEN k%2=0 THEN CASE band WHEN 'B04' THEN 'r' WHEN 'B03' THEN 'g' WHEN 'B02' THEN 'b' END ELSE CASE band WHEN 'B04' THEN 'r4' WHEN 'B03' THEN 'g4' END END AS href,
 path, band <> 'SCL' AS to_reflectance, k%3 <> 0 AS reproject FROM p WHERE path NOT IN (SELECT path FROM done)""",
)

REGISTRY = {
    "search_scenes": (
        search_scenes,
        with_sql([CATALOG_SQL], f"SELECT id, date, clouds FROM cat WHERE {_WHERE} ORDER BY dt, id LIMIT 200"),
    ),
    "search_all_scenes": (search_all, with_sql([CATALOG_SQL], f"SELECT id FROM cat WHERE {_WHERE}")),
    "scene_products": (scene_products, PRODUCTS_SQL),
}
