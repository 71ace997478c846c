"""Geometry operators and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators import fields, geometry, spatial
from workloads.inputs import table, with_sql
from workloads.tables_q import _round


def _lines(spark, sf):
    """One polyline per order: its items as vertices in line order."""
    from fieldspark.operators.tracks import points_to_lines

    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("y"),
    )
    return points_to_lines(li, ["l_orderkey"], ["l_linenumber", "x", "y"]).select("l_orderkey", "geom")


_SEG = """seg AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount*100+l_linenumber AS y,
 lead(l_quantity) OVER w AS nx, lead(l_discount*100+l_linenumber) OVER w AS ny
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount*100+l_linenumber))"""


def line_length(spark, sf):
    d = fields.line_length(_lines(spark, sf), mode="cartesian", srid=32722)
    return d.select("l_orderkey", "length")


def explode_lines(spark, sf):
    d = geometry.explode_lines(_lines(spark, sf))
    g = F.col("geom")
    return d.select(
        "l_orderkey",
        F.round(g[0].x, 6).alias("x"),
        F.round(g[0].y, 6).alias("y"),
        F.round(g[1].x, 6).alias("nx"),
        F.round(g[1].y, 6).alias("ny"),
    )


def explode_multipart(spark, sf):
    """Parts of the orders' lines grouped per customer region of keys."""
    li = table(spark, sf, "lineitem")
    parts = li.groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y")))).alias("geom")
    )
    d = geometry.explode_multipart(parts)
    return d.select("l_suppkey", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))


def implement_trail(spark, sf):
    d = geometry.implement_trail(_lines(spark, sf), 2.0, 32722)
    area = geo.polygon_area(F.col("geom"))
    return d.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(area), 4).alias("area"))


# A capsule of radius 1 over a segment: 2 * length plus a regular 20-gon.
TRAIL_SQL = with_sql(
    [_SEG],
    """SELECT l_orderkey, count(*) AS segments, round(sum(2*sqrt(pow(nx-x,2)+pow(ny-y,2)) + 10*sin(pi()/10)),4) AS area
FROM seg WHERE nx IS NOT NULL GROUP BY l_orderkey""",
)


def polygon_area(spark, sf):
    c = table(spark, sf, "customer")
    w, h = F.col("c_custkey") % 97 + 1.0, F.col("c_nationkey") + 2.0
    tri = F.array(geo.point(F.lit(3.0), F.lit(4.0)), geo.point(w + 3, F.lit(4.0)), geo.point(F.lit(3.0), h + 4))
    d = c.select("c_custkey", F.array(tri).alias("geom"))
    d = fields.polygon_area_ha(d, mode="cartesian", srid=32722, precision=6)
    return d.select("c_custkey", "area")


def centroid(spark, sf):
    c = table(spark, sf, "customer")
    w, h = F.col("c_custkey") % 97 + 1.0, F.col("c_nationkey") + 2.0
    tri = F.array(geo.point(F.lit(3.0), F.lit(4.0)), geo.point(w + 3, F.lit(4.0)), geo.point(F.lit(3.0), h + 4))
    d = c.select("c_custkey", geometry.rep_point(F.array(tri), "polygon").alias("p"))
    return d.select("c_custkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def layer_units(spark, sf):
    c = table(spark, sf, "customer")
    m = F.col("c_acctbal")
    return c.select(
        "c_custkey",
        F.round(geo.to_layer_units(m, True), 9).alias("deg"),
        F.round(geo.to_layer_units(m, False, 0.3048), 6).alias("feet"),
    )


def _boxes(spark, sf):
    s = table(spark, sf, "supplier")
    x, y = F.col("s_acctbal") / 100, F.col("s_suppkey") % 40
    # Added up in the order of the SQL: x + (w + 0.5) may be off by a rounding, and a point on the side is then lost or won.
    right, top = x + F.col("s_nationkey") % 5 + 0.5, y + F.col("s_nationkey") % 7 + 0.5
    ring = F.array(geo.point(x, y), geo.point(right, y), geo.point(right, top), geo.point(x, top))
    return s.select(F.col("s_suppkey").alias("fid"), F.array(ring).alias("geom"), F.col("s_nationkey").alias("nk"))


def _dots(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("fid"),
        geo.point(F.col("c_acctbal") / 100 + 0.003, F.col("c_custkey") % 47 + 0.25).alias("geom"),
    )


_BOXES_SQL = """bx AS (SELECT s_suppkey AS fid, s_nationkey AS nk, s_acctbal/100 AS x0, s_suppkey%40 AS y0,
 s_acctbal/100 + s_nationkey%5+0.5 AS x1, s_suppkey%40 + s_nationkey%7+0.5 AS y1 FROM supplier),
dt AS (SELECT c_custkey AS fid, c_acctbal/100+0.003 AS x, c_custkey%47+0.25 AS y FROM customer)"""
_INSIDE = "dt.x BETWEEN x0 AND x1 AND dt.y BETWEEN y0 AND y1"


def spatial_join(spark, sf):
    d = spatial.spatial_join(_dots(spark, sf), _boxes(spark, sf))
    return d.select(F.col("a.fid").alias("point"), F.col("b.fid").alias("box"))


def spatial_join_sizes(spark, sf):
    """Boxes of very different sizes: one holds everything, one in ten is a strip across half of the area."""
    b = _boxes(spark, sf)
    wide = F.when(F.col("fid") % 10 == 0, 50.0).otherwise(F.col("nk") % 5 + 0.5)
    first = F.element_at(F.element_at("geom", 1), 1)
    x, y, h = first.x, first.y, F.col("nk") % 7 + 0.5
    ring = F.array(geo.point(x, y), geo.point(x + wide, y), geo.point(x + wide, y + h), geo.point(x, y + h))
    corner = lambda v, w: geo.point(F.lit(v), F.lit(w))
    whole = F.array(corner(-1e3, -1e3), corner(1e3, -1e3), corner(1e3, 1e3), corner(-1e3, 1e3))
    country = b.agg((-F.max("fid")).alias("fid")).withColumn("geom", F.array(whole))
    areas = b.select("fid", F.array(ring).alias("geom")).unionByName(country)
    d = spatial.spatial_join(areas, areas, "polygon", "polygon", self_join="fid")
    return d.select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"))


SIZES_SQL = """WITH bx AS (SELECT s_suppkey AS fid, s_acctbal/100 AS x0, s_suppkey%40 AS y0,
 s_acctbal/100 + CASE WHEN s_suppkey%10 = 0 THEN 50.0 ELSE s_nationkey%5+0.5 END AS x1, s_suppkey%40 + s_nationkey%7+0.5 AS y1 FROM supplier
 UNION ALL SELECT -max(s_suppkey), -1e3, -1e3, 1e3, 1e3 FROM supplier)
SELECT a.fid AS a, b.fid AS b FROM bx a JOIN bx b ON a.fid < b.fid AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"""


def extract_by_location(spark, sf):
    d = spatial.extract_by_location(_boxes(spark, sf), _dots(spark, sf), "fid")
    return d.select("fid")


def box_pairs(spark, sf):
    b = _boxes(spark, sf)
    d = spatial.spatial_join(b, b, "polygon", "polygon", self_join="fid")
    return d.select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"))


def reverse_geocode(spark, sf):
    areas = _boxes(spark, sf).select(
        F.col("geom").alias("rings"),
        F.when(F.col("fid") % 4 == 0, 8).when(F.col("fid") % 4 == 1, 5).when(F.col("fid") % 4 == 2, 4).otherwise(3).alias("admin_level"),
        F.concat(F.lit("area"), F.col("fid")).alias("name"),
    )
    d = spatial.reverse_geocode(_dots(spark, sf), areas)
    return d.select("fid", *spatial.ADMIN_LEVELS)


GEOCODE_SQL = with_sql(
    [_BOXES_SQL],
    "SELECT dt.fid, "
    + ", ".join(
        f"max(CASE WHEN bx.fid%4={m} THEN 'area' || bx.fid END) AS {n}"
        for n, m in (("municipality", 0), ("district", 1), ("state", 2), ("region", 3))
    )
    + f" FROM dt LEFT JOIN bx ON {_INSIDE} GROUP BY dt.fid",
)


def regular_grid(spark, sf):
    d = geometry.regular_grid(_dots(spark, sf), 7.0, 3.0, feature_kind="point")
    return d.select("id", "row", "col", F.round(F.col("geom")[0][0].x, 6).alias("left"), F.round(F.col("geom")[0][0].y, 6).alias("top"))


GRID_SQL = with_sql(
    [
        _BOXES_SQL,
        "e AS (SELECT min(x) AS x0, max(y) AS y0, ceil((max(x)-min(x))/7) AS nc, ceil((max(y)-min(y))/3) AS nr FROM dt)",
        "cells AS (SELECT r AS row, c AS col, x0, y0, nr FROM e, (SELECT unnest(range(0,2000)) AS r) a, (SELECT unnest(range(0,2000)) AS c) b WHERE r < nr AND c < nc)",
    ],
    """SELECT DISTINCT CAST(col*nr+row+1 AS BIGINT) AS id, row, col, round(x0+col*7,6) AS left, round(y0-row*3,6) AS top
FROM cells JOIN dt ON dt.x BETWEEN x0+col*7 AND x0+(col+1)*7 AND dt.y BETWEEN y0-(row+1)*3 AND y0-row*3""",
)


def regular_grid_points(spark, sf):
    d = geometry.regular_grid(_boxes(spark, sf), 1.7, 1.3, "point")
    return d.select("id", "row", "col", F.round(F.col("geom").x, 6).alias("x"), F.round(F.col("geom").y, 6).alias("y"))


def regular_grid_lines(spark, sf):
    d = geometry.regular_grid(_boxes(spark, sf), 1.7, 1.3, "line")
    last = F.element_at("geom", -1)
    return d.select("id", "row", "col", F.round(last.x, 6).alias("x"), F.round(last.y, 6).alias("y"))


_GRID_OF_BOXES = """e AS (SELECT min(x0) AS gx, max(y1) AS gy, ceil((max(x1)-min(x0))/1.7::DOUBLE)::BIGINT AS nc, ceil((max(y1)-min(y0))/1.3::DOUBLE)::BIGINT AS nr FROM bx),
r AS (SELECT unnest(range(0,200)) AS row), c AS (SELECT unnest(range(0,2000)) AS col)"""


def offset_lines(spark, sf):
    s = table(spark, sf, "supplier")
    line = F.array(
        geo.point(F.col("s_suppkey"), F.lit(0.0)),
        geo.point(F.col("s_suppkey") + 3.0, F.lit(4.0)),
    )
    d = geometry.offset_lines(s.select("s_suppkey", line.alias("geom")), 5.0, 2)
    return d.select("s_suppkey", "offset", F.round(F.col("geom")[0].x, 6).alias("x"), F.round(F.col("geom")[1].y, 6).alias("y"))


OFFSET_SQL = """SELECT s_suppkey, o AS "offset", round(s_suppkey - 0.8*o,6) AS x, round(4+0.6*o,6) AS y
FROM supplier, (VALUES (5.0::DOUBLE),(-5.0),(10.0),(-10.0)) t(o)"""


def utm_round_trip(spark, sf):
    """Geographic to UTM and back returns the same place."""
    from fieldspark.functions.crs import reproject

    c = table(spark, sf, "customer").select(
        "c_custkey", geo.point(-54.0 + F.col("c_acctbal") / 5000, -15.0 + F.col("c_nationkey") / 10).alias("geom")
    )
    d = reproject(reproject(c, "geom", 4326, 32722), "geom", 32722, 4326)
    return d.select("c_custkey", F.round("geom.x", 8).alias("x"), F.round("geom.y", 8).alias("y"), "srid")


def photo_footprints(spark, sf):
    """Nadir shots over flat ground: the outline is a rotated rectangle."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey"),
        F.lit(0.0).alias("Lat"),
        F.lit(0.0).alias("Lon"),
        (F.col("c_custkey") % 100 + 20).alias("RelativeAltitude"),
        F.lit(0.0).alias("GimbalYawDegree"),
        F.lit(-90.0).alias("GimbalPitchDegree"),
        F.lit(0.0).alias("GimbalRollDegree"),
        F.array(F.lit(24.0)).alias("LensSpecification"),
    )
    d = geometry.photo_footprints(c)
    f = F.col("footprint")
    return d.select(
        "c_custkey",
        F.round((f[1].x - f[0].x) * geo.METRES_PER_DEGREE, 4).alias("width"),
        F.round((f[0].y - f[2].y) * geo.METRES_PER_DEGREE, 4).alias("height"),
        "is_nadir",
    )


REGISTRY = {
    "line_length": (
        line_length,
        with_sql([_SEG], "SELECT l_orderkey, round(sum(sqrt(pow(nx-x,2)+pow(ny-y,2))),4) AS length FROM seg WHERE nx IS NOT NULL GROUP BY 1"),
    ),
    "explode_lines": (
        explode_lines,
        with_sql([_SEG], "SELECT l_orderkey, round(x,6) AS x, round(y,6) AS y, round(nx,6) AS nx, round(ny,6) AS ny FROM seg WHERE nx IS NOT NULL"),
    ),
    "explode_multipart": (explode_multipart, "SELECT l_suppkey, l_quantity AS x, l_tax AS y FROM lineitem"),
    "implement_trail": (implement_trail, TRAIL_SQL),
    "polygon_area": (polygon_area, "SELECT c_custkey, round((c_custkey%97+1.0)*(c_nationkey+2.0)/2/10000,6) AS area FROM customer"),
    "centroid": (
        centroid,
        "SELECT c_custkey, round(3+(c_custkey%97+1.0)/3,6) AS x, round(4+(c_nationkey+2.0)/3,6) AS y FROM customer",
    ),
    "layer_units": (
        layer_units,
        "SELECT c_custkey, round(c_acctbal/111320,9) AS deg, round(c_acctbal/0.3048,6) AS feet FROM customer",
    ),
    "spatial_join": (spatial_join, with_sql([_BOXES_SQL], f"SELECT dt.fid AS point, bx.fid AS box FROM dt JOIN bx ON {_INSIDE}")),
    "spatial_join_sizes": (spatial_join_sizes, SIZES_SQL),
    "extract_by_location": (
        extract_by_location,
        with_sql([_BOXES_SQL], f"SELECT DISTINCT bx.fid FROM bx JOIN dt ON {_INSIDE}"),
    ),
    "box_pairs": (
        box_pairs,
        with_sql([_BOXES_SQL], "SELECT p.fid AS a, q.fid AS b FROM bx p JOIN bx q ON p.fid < q.fid AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1"),
    ),
    "reverse_geocode": (reverse_geocode, GEOCODE_SQL),
    "regular_grid": (regular_grid, GRID_SQL),
    "regular_grid_points": (
        regular_grid_points,
        with_sql(
            [_BOXES_SQL, _GRID_OF_BOXES],
            """SELECT DISTINCT (col*(nr+1)+row+1)::BIGINT AS id, row, col, round(gx+col*1.7::DOUBLE,6) AS x, round(gy-row*1.3::DOUBLE,6) AS y
FROM e, r, c JOIN bx ON gx+col*1.7::DOUBLE BETWEEN x0 AND x1 AND gy-row*1.3::DOUBLE BETWEEN y0 AND y1 WHERE row <= nr AND col <= nc""",
        ),
    ),
    "regular_grid_lines": (
        regular_grid_lines,
        with_sql(
            [_BOXES_SQL, _GRID_OF_BOXES],
            """SELECT DISTINCT (row+1)::BIGINT AS id, row, NULL::BIGINT AS col, round(gx+nc*1.7::DOUBLE,6) AS x, round(gy-row*1.3::DOUBLE,6) AS y
FROM e, r JOIN bx ON gy-row*1.3::DOUBLE BETWEEN y0 AND y1 WHERE row <= nr UNION ALL
SELECT DISTINCT (nr+1+col+1)::BIGINT, NULL::BIGINT, col, round(gx+col*1.7::DOUBLE,6), round(gy-nr*1.3::DOUBLE,6)
FROM e, c JOIN bx ON gx+col*1.7::DOUBLE BETWEEN x0 AND x1 WHERE col <= nc""",
        ),
    ),
    "offset_lines": (offset_lines, OFFSET_SQL),
    "utm_round_trip": (
        utm_round_trip,
        "SELECT c_custkey, round(-54.0+c_acctbal/5000,8) AS x, round(-15.0+c_nationkey/10,8) AS y, 4326 AS srid FROM customer",
    ),
    "photo_footprints": (
        photo_footprints,
        """SELECT c_custkey, round((c_custkey%100+20)*2*18*0.7/24,4) AS width, round((c_custkey%100+20)*2*12*0.7/24,4) AS height,
 true AS is_nadir FROM customer""",
    ),
}
