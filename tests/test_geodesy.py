"""Ellipsoid lengths and areas against known WGS84 values."""

from pyspark.sql import functions as F

from fieldspark.functions import geo


def test_geodesic_distance(spark):
    r = spark.range(1).select(
        geo.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("north"),
        geo.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("east"),
        geo.geodesic_distance(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("none"),
    ).first()
    assert abs(r.north - 110574.389) < 0.01
    assert abs(r.east - 111319.491) < 0.01
    assert r.none == 0.0
