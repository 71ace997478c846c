"""Regions of equal pixels with their outlines, and cells dissolved by class, whose outlines keep the corners of all cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators import outlines
from workloads.inputs import PIXELS_SQL, pixels

_KEYS = ["raster_id", "band", "region_row", "region_col"]


def _classes(spark, sf):
    return pixels(spark, sf).withColumn("value", F.floor("value").cast("double") % 3)


def _measured(corners, keys):
    return outlines.ring_table(corners, keys).groupBy(*keys).agg(
        F.sum("corners").alias("corners"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter")
    )


def region_outlines(spark, sf):
    labelled = outlines.label_regions(_classes(spark, sf), tile=16)
    cells = labelled.groupBy(*_KEYS).agg(F.max("value").alias("value"), F.count("*").alias("cells"))
    return cells.join(_measured(outlines.region_outlines(labelled), _KEYS), _KEYS).drop("band")


def dissolved_cells(spark, sf):
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    at = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    square = F.array(F.array(*[geo.point(x + i, y + j) for i, j in at]))
    return _measured(outlines.dissolve(_classes(spark, sf).withColumn("geom", square), ["raster_id", "value"]), ["raster_id", "value"])


_CLASSES_SQL = "cls AS (SELECT raster_id, row, col, floor(value) % 3 AS v FROM pixels)"
_SIDES = "(VALUES (0,1),(0,-1),(1,0),(-1,0)) d(i,j)"
# Of each cell: sides to other regions, and corners where its region's outline turns outwards or inwards.
_MEASURED_SQL = f"""sides AS (SELECT a.raster_id, a.name, count(*) - count(b.name) AS n FROM names a CROSS JOIN {_SIDES}
 LEFT JOIN names b ON b.raster_id = a.raster_id AND b.row = a.row + i AND b.col = a.col + j AND b.name = a.name GROUP BY 1, 2),
turns AS (SELECT a.raster_id, a.name, sum(CASE WHEN h.name IS NULL AND w.name IS NULL THEN 1 WHEN h.name IS NOT NULL AND w.name IS NOT NULL AND x.name IS NULL THEN 1 ELSE 0 END) AS n
 FROM names a CROSS JOIN (VALUES (1,1),(1,-1),(-1,1),(-1,-1)) d(i,j)
 LEFT JOIN names h ON h.raster_id = a.raster_id AND h.row = a.row AND h.col = a.col + j AND h.name = a.name
 LEFT JOIN names w ON w.raster_id = a.raster_id AND w.row = a.row + i AND w.col = a.col AND w.name = a.name
 LEFT JOIN names x ON x.raster_id = a.raster_id AND x.row = a.row + i AND x.col = a.col + j AND x.name = a.name GROUP BY 1, 2),
sizes AS (SELECT raster_id, name, max(v) AS v, count(*) AS n FROM names GROUP BY 1, 2)"""
_FROM = "FROM sizes s JOIN sides p USING (raster_id, name) JOIN turns t USING (raster_id, name)"

REGISTRY = {
    "region_outlines": (
        region_outlines,
        f"""WITH RECURSIVE {PIXELS_SQL}, {_CLASSES_SQL},
reach AS (SELECT raster_id, row AS sr, col AS sc, row, col, v FROM cls UNION
 SELECT r.raster_id, r.sr, r.sc, c.row, c.col, c.v FROM reach r CROSS JOIN {_SIDES} JOIN cls c
 ON c.raster_id = r.raster_id AND c.row = r.row + i AND c.col = r.col + j AND c.v = r.v),
names AS (SELECT raster_id, row, col, v, min(sr * 10000 + sc) AS name FROM reach GROUP BY 1, 2, 3, 4),
{_MEASURED_SQL}
SELECT raster_id, CAST(name // 10000 AS INTEGER) AS region_row, CAST(name % 10000 AS INTEGER) AS region_col, s.v AS value, s.n AS cells,
 CAST(t.n AS BIGINT) AS corners, CAST(s.n AS DOUBLE) AS area, CAST(p.n AS DOUBLE) AS perimeter {_FROM}""",
    ),
    "dissolved_cells": (
        dissolved_cells,
        f"""WITH {PIXELS_SQL}, {_CLASSES_SQL}, names AS (SELECT *, v AS name FROM cls),
{_MEASURED_SQL}
SELECT raster_id, s.v AS value, CAST(p.n AS BIGINT) AS corners, CAST(s.n AS DOUBLE) AS area, CAST(p.n AS DOUBLE) AS perimeter
FROM sizes s JOIN sides p USING (raster_id, name)""",
    ),
}
