"""Reprojected rasters against positions worked out in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import resample, warp

GRID = "raster_id int, x0 double, y0 double, dx double, dy double, ncols int, nrows int, srid int, nodata double"
PIXELS = "raster_id int, band int, row int, col int, value double"
A, FLATTENING = 6378137.0, 1 / 298.257223563


def utm(lon, lat, zone, south):
    """Transverse Mercator by the meridian arc and powers of the longitude (another series than the library's)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep, phi, dl = e2 / (1 - e2), math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n, t, c, a = A / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep * math.cos(phi) ** 2, dl * math.cos(phi)
    m = A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi)
    )
    x = 0.9996 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * a**5 / 120) + 500000
    y = 0.9996 * (m + n * math.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
    return x, y + (1e7 if south else 0)


def mercator(lon, lat):
    return math.radians(lon) * A, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * A


@pytest.fixture
def fields(spark):
    """A raster in UTM with 30 m cells, one without data in places; world positions are known from the formulas."""
    grids = spark.createDataFrame([(1, 300000.0, 7500000.0, 30.0, 30.0, 70, 60, 32722, -9.0)], GRID)
    px = [(1, b, r, c, -9.0 if (r, c) == (7, 7) else b * 1000.0 + r + 0.01 * c) for b in (1, 2) for r in range(60) for c in range(70)]
    return spark.createDataFrame(px, PIXELS), grids


def source(lon, lat):
    x, y = utm(lon, lat, 22, True)
    return (x - 300000) / 30, (7500000 - y) / 30


TARGET = resample.Grid(-52.9505, -22.5905, 0.0004, 0.0003, 60, 70)


def cells():
    for r in range(TARGET.nrows):
        for c in range(TARGET.ncols):
            yield r, c, *source(TARGET.x0 + (c + 0.5) * TARGET.dx, TARGET.y0 - (r + 0.5) * TARGET.dy)


@pytest.mark.parametrize("tolerance", [0.0, 1e-4, 0.125])
def test_positions(fields, tolerance):
    _, grids = fields
    got = {(p.row, p.col): (p.u, p.v) for p in warp.positions(grids, warp.as_grids(grids, TARGET), 4326, tolerance).collect()}
    room = tolerance + 1e-4
    for r, c, u, v in cells():
        if room < u < 70 - room and room < v < 60 - room:
            assert max(abs(got[r, c][0] - u), abs(got[r, c][1] - v)) <= room, (r, c)
        elif u < -room or v < -room or u > 70 + room or v > 60 + room:
            assert (r, c) not in got
    assert len(got) > 1500


def test_mesh_is_refined_where_it_must_be(spark):
    """A grid over half a hemisphere: straight edges between few points would be off by many cells."""
    grids = spark.createDataFrame([(1, -2e7, 2e7, 1e5, 1e5, 400, 400, 3857, -1.0)], GRID)
    target = warp.as_grids(grids, resample.Grid(-90.0, 80.0, 0.5, 0.5, 360, 320))
    got = warp.positions(grids, target, 4326, 0.125).collect()
    assert len(got) == 360 * 320
    for p in got[::37]:
        x, y = mercator(-90 + (p.col + 0.5) * 0.5, 80 - (p.row + 0.5) * 0.5)
        assert max(abs((x + 2e7) / 1e5 - p.u), abs((2e7 - y) / 1e5 - p.v)) <= 0.125


def test_nearest_and_statistics(fields):
    px, grids = fields
    got = {(p.band, p.row, p.col): p.value for p in warp.reproject_raster(px, grids, TARGET, 4326).collect()}
    wrong = 0
    for r, c, u, v in cells():
        inside = 0 <= u < 70 and 0 <= v < 60 and (int(v), int(u)) != (7, 7)
        for b in (1, 2):
            want = b * 1000.0 + int(v) + 0.01 * int(u) if inside else None
            wrong += got.get((b, r, c)) != want
    # Only cells at an edge, where an eighth of a cell decides, may differ.
    assert wrong <= 0.02 * len(got)
    counts = warp.reproject_raster(px.withColumn("value", F.when(F.col("value") != -9.0, 1.0).otherwise(-9.0)), grids, TARGET, 4326, "sum")
    assert counts.filter("band = 1").agg(F.sum("value")).first()[0] <= 60 * 70 - 1
    assert counts.agg(F.max("value")).first()[0] <= 4


@pytest.mark.parametrize("method", ["bilinear", "cubic", "lanczos", "cubic_spline"])
def test_kernels_keep_a_plane(fields, method):
    """A value that is linear in the source stays so, away from edges and from the cell without data."""
    px, grids = fields
    flat = px.filter("band = 1").withColumn("value", F.col("row") * 2.0 + F.col("col") * 0.25 + 5)
    got = {(p.row, p.col): p.value for p in warp.reproject_raster(flat, grids, TARGET, 4326, method, 1e-5).collect()}
    room = 0.05 if method == "lanczos" else 1e-3
    seen = 0
    for r, c, u, v in cells():
        if 4 < u < 66 and 4 < v < 56:
            seen += 1
            assert abs(got[r, c] - (2 * (v - 0.5) + 0.25 * (u - 0.5) + 5)) < room
    assert seen > 1000


def test_grids_there_and_back(fields):
    _, grids = fields
    there = warp.warp_grids(grids, 4326)
    g = there.first()
    for u, v in ((0, 0), (70, 0), (0, 60), (70, 60)):
        back = [(lon, lat) for lon in (g.x0, g.x0 + g.ncols * g.dx) for lat in (g.y0, g.y0 - g.nrows * g.dy)]
        assert min(source(*p)[0] for p in back) <= u + 1e-3 and max(source(*p)[1] for p in back) >= v - 1e-3
    assert g.srid == 4326 and abs(math.hypot(g.ncols, g.nrows) - math.hypot(70, 60)) < 3
    home = warp.warp_grids(there, 32722, 30.0).first()
    assert home.x0 <= 300000 + 1 and home.y0 >= 7500000 - 1 and home.ncols >= 70 and home.nrows >= 60


def test_resample_takes_rasters_of_several_systems(spark, fields):
    px, grids = fields
    both = grids.unionByName(grids.withColumns({"raster_id": F.lit(2), "x0": F.lit(TARGET.x0), "y0": F.lit(TARGET.y0), "dx": F.lit(TARGET.dx), "dy": F.lit(TARGET.dy), "srid": F.lit(4326)}))
    all_px = px.unionByName(px.withColumn("raster_id", F.lit(2)))
    d = resample.resample(all_px, both, TARGET, "nearest", 4326)
    n = {r.raster_id: r["count"] for r in d.groupBy("raster_id").count().collect()}
    assert n[1] > 3000 and n[2] == 2 * (60 * 60 - 1)
    with pytest.raises(ValueError):
        warp.reproject_raster(px, grids, TARGET, 4326, "best")
    with pytest.raises(ValueError, match="coordinate system"):
        warp.warp_grids(grids.withColumn("srid", F.lit(None).cast("int")), 4326)
