"""Capsules along lines: their vertices, areas of rings with few vertices, and that vertices are compiled."""

import math

from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators import geometry

POINTS = "array<struct<x:double,y:double>>"


def test_capsules(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0)]), (2, [(1.0, 1.0)])], f"id int, geom {POINTS}")
    trail = geometry.implement_trail(lines, 2.0, 32722)
    assert trail.columns == ["id", "segment", "geom"]
    long, point = sorted(trail.collect(), key=lambda r: r.segment)
    (ring,), heading = long.geom, math.atan2(4.0, 3.0)
    assert len(ring) == 22 and len(point.geom[0]) == 20
    for (cx, cy), half, part in (((3.0, 4.0), 1, ring[:11]), ((0.0, 0.0), -1, ring[11:])):
        for k, v in enumerate(part):
            a = heading + half * math.pi / 2 - k * math.pi / 10
            assert math.isclose(v.x, cx + math.cos(a), abs_tol=1e-12) and math.isclose(v.y, cy + math.sin(a), abs_tol=1e-12)
    # Each vertex is an expression of its own and not made by a function over steps, which Spark doesn't compile.
    plan = trail.select("geom")._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("cos(") >= 22


def test_areas_of_few_vertices(spark):
    rings = [[], [(1.0, 2.0)], [(0.0, 0.0), (2.0, 1.0)], [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], None]
    d = spark.createDataFrame(list(enumerate(rings)), f"i int, r {POINTS}").select("i", geo.ring_area(F.col("r")).alias("a"))
    assert [r.a for r in d.orderBy("i").collect()] == [0.0, 0.0, 0.0, 2.0, 0.0]
