"""Box joins of any mix of sizes, and polygons on pixel grids, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import sample, scanline, spatial

BOXES = "fid long, xmin double, ymin double, xmax double, ymax double"


def boxes(n, rnd, sizes, first=0, extent=1000.0):
    out = []
    for i in range(n):
        x, y, s = rnd.uniform(-extent, extent), rnd.uniform(-extent, extent), rnd.choice(sizes)
        w, h = s * rnd.random(), s * rnd.random()
        out.append((first + i, x, y, x + w, y + h))
    return out


def meet(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


def pairs_of(df):
    got = [(r.a.fid, r.b.fid) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_box_join_of_mixed_sizes(spark, seed):
    rnd = random.Random(seed)
    a = boxes(150, rnd, [0, 0, 1, 40, 700]) + [(900, -1000.0, -1000.0, 1000.0, 1000.0), (901, 3.0, 3.0, 3.0, 3.0), (902, None, 1.0, 2.0, 2.0)]
    b = boxes(150, rnd, [0, 0.01, 5, 300]) + [(900, -2e3, -2e3, 2e3, 2e3), (901, 3.0, 3.0, 3.0, 3.0), (902, 4.0, 4.0, 16.0, 8.0), (903, 16.0, 8.0, 64.0, 64.0)]
    want = {(x[0], y[0]) for x in a if x[1] is not None for y in b if meet(x, y)}
    da, db = spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES)
    assert pairs_of(spatial.box_join(da, db)) == want
    own = [x for x in a if x[1] is not None]
    assert pairs_of(spatial.box_join(da, da, self_join="fid")) == {(x[0], y[0]) for x in own for y in own if x[0] < y[0] and meet(x, y)}
    dots = [(i, x, y, x, y) for i, x, y, _, _ in own]
    dd = spark.createDataFrame(dots, BOXES)
    assert pairs_of(spatial.box_join(dd, db, points="a")) == {(x[0], y[0]) for x in dots for y in b if meet(x, y)}
    assert pairs_of(spatial.box_join(db, dd, points="b")) == {(y[0], x[0]) for x in dots for y in b if meet(x, y)}
    assert spatial.box_join(da.limit(0), db).count() == 0


def test_box_join_lists_few_cells(spark):
    """One box of the whole extent among small ones takes four cells, the others four a level."""
    rnd = random.Random(5)
    rows = boxes(500, rnd, [0.5]) + [(999, -1000.0, -1000.0, 1000.0, 1000.0)]
    d = spatial._leveled(spark.createDataFrame(rows, BOXES), "a")
    cells = spatial._cells(d, "a", F.array("_a_own")).groupBy("_a_0").count().agg(F.max("count")).first()[0]
    assert cells <= 4
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    spatial.box_join(spark.createDataFrame(rows, BOXES), spark.createDataFrame(rows, BOXES))
    assert len(jobs.getJobIdsForGroup()) == before


GRID = "raster_id int, x0 double, y0 double, dx double, dy double, ncols int, nrows int, srid int, nodata double"
GRIDS = [(1, 0.0, 50.0, 1.0, 1.0, 60, 50, 32722, -9999.0), (2, 10.5, 47.25, 0.75, 1.25, 90, 40, 32722, -9999.0)]
MASK = "fid long, rings array<array<struct<x:double,y:double>>>"


def inside(rings, px, py):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def near(rings, px, py, reach):
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            dx, dy = bx - ax, by - ay
            n = dx * dx + dy * dy
            t = 0.0 if n == 0 else min(max(((px - ax) * dx + (py - ay) * dy) / n, 0.0), 1.0)
            if math.hypot(px - (ax + t * dx), py - (ay + t * dy)) <= reach:
                return True
    return False


def centres():
    for g, x0, y0, dx, dy, nc, nr, *_ in GRIDS:
        for r in range(nr):
            for c in range(nc):
                yield g, r, c, x0 + (c + 0.5) * dx, y0 - (r + 0.5) * dy, max(dx, dy)


SHAPES = [
    (1, [[(5.0, 5.0), (40.3, 7.7), (22.2, 44.4)]]),
    # A square with a hole, edges through centres.
    (2, [[(20.5, 10.5), (40.5, 10.5), (40.5, 30.5), (20.5, 30.5)], [(25.0, 15.0), (30.0, 15.0), (30.0, 25.0), (25.0, 25.0)]]),
    # A bow tie, partly outside every raster.
    (3, [[(-10.0, 0.0), (30.0, 45.0), (-10.0, 45.0), (30.0, 0.0)]]),
    (3, [[(50.0, 1.0), (58.0, 1.0), (58.0, 49.9), (50.0, 20.0)]]),
    # Twice the same mask, one of no area, one far away, one without rings.
    (4, [[(1.0, 1.0), (9.0, 2.0), (4.0, 9.0)]]), (4, [[(1.0, 1.0), (9.0, 2.0), (4.0, 9.0)]]), (5, [[(3.0, 3.0), (9.0, 3.0)]]),
    (6, [[(500.0, 500.0), (600.0, 500.0), (550.0, 600.0)]]), (7, []), (8, None), (None, [[(33.0, 33.0), (39.0, 33.5), (35.0, 39.0)]]),
]


@pytest.fixture
def layers(spark):
    grids = spark.createDataFrame(GRIDS, GRID)
    px = spark.createDataFrame([(g, 1, r, c, float(r * 100 + c)) for g, r, c, *_ in centres()], "raster_id int, band int, row int, col int, value double")
    return px, grids, spark.createDataFrame(SHAPES, MASK)


@pytest.mark.parametrize("buffer", [0.0, 1.5])
def test_clip(layers, buffer):
    px, grids, masks = layers
    hit = lambda rings, x, y, step: inside(rings, x, y) or (buffer and near(rings, x, y, buffer * step))
    want = sorted((f or -1, g, r, c) for g, r, c, x, y, step in centres() for f, rings in SHAPES if rings and hit(rings, x, y, step))
    got = sample.clip_raster(px, grids, masks, per_feature=True, buffer_pixels=buffer).collect()
    assert sorted((-1 if r.feature is None else r.feature, r.raster_id, r.row, r.col) for r in got) == want
    together = sample.clip_raster(px, grids, masks, buffer_pixels=buffer).collect()
    assert sorted((r.raster_id, r.row, r.col) for r in together) == sorted({w[1:] for w in want})


def test_spans_do_not_overlap(layers):
    _, grids, masks = layers
    spans = scanline.polygon_spans(masks, grids).collect()
    cells = [(s.feature, s.mask, s.raster_id, s.row, c) for s in spans for c in range(s.first, s.last + 1)]
    assert len(cells) == len(set(cells)) > 1000


def test_rasterize(spark, layers):
    _, grids, masks = layers
    valued = masks.withColumn("value", F.when(F.col("fid") != 2, F.col("fid") * 1.5))
    top = {}
    for g, r, c, x, y, _ in centres():
        held = [f for f, rings in SHAPES if f and rings and inside(rings, x, y)]
        if held:
            top[g, r, c] = None if max(held) == 2 else max(held) * 1.5
    got = scanline.rasterize_polygons(valued.filter("fid is not null"), grids).collect()
    assert {(p.raster_id, p.row, p.col): p.value for p in got} == top and len(got) == len(top)


def test_ring_of_many_vertices(spark):
    n = 100_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 400 + 30 * np.sin(40 * t)
    ring = [[(float(500 + r * np.cos(a)), float(500 + r * np.sin(a))) for r, a in zip(radius, t, strict=True)]]
    masks = spark.createDataFrame([(1, ring)], MASK)
    grids = spark.createDataFrame([(1, 0.0, 1000.0, 1.0, 1.0, 1000, 1000, 1, -1.0)], GRID)
    spans = scanline.polygon_spans(masks, grids).agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    # Pixels inside, by the polar form of the ring.
    c = np.arange(1000) + 0.5
    x, y = np.meshgrid(c - 500, c - 500)
    want = int((np.hypot(x, y) < 400 + 30 * np.sin(40 * np.arctan2(y, x))).sum())
    assert abs(spans - want) <= 20
    px = spark.range(1000).select(F.lit(1).alias("raster_id"), F.lit(1).alias("band"), F.col("id").cast("int").alias("row"),
                                  F.explode(F.sequence(F.lit(0), F.lit(999))).alias("col"), F.lit(1.0).alias("value"))
    assert sample.zonal_statistics(px, grids, masks).first()["count"] == spans


def test_points_to_rasters(spark, layers):
    px, grids, _ = layers
    rnd = random.Random(6)
    pts = [(i, rnd.uniform(-5, 90), rnd.uniform(-5, 55)) for i in range(200)]
    d = sample.sample_rasters(spark.createDataFrame(pts, "fid long, x double, y double"), px, grids, prefix="r")
    for r in d.collect():
        for g, x0, y0, dx, dy, nc, nr, *_ in GRIDS:
            c, row = math.floor((r.x - x0) / dx), math.floor((y0 - r.y) / dy)
            assert r[f"r{g}"] == (row * 100 + c if 0 <= c < nc and 0 <= row < nr else None)


def test_boxes_need_no_exact_test(spark):
    """Points and upright rectangles meet as boxes, whatever is slow stays off their join; other rings are still tested."""
    rnd = random.Random(8)
    square = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]
    shapes = [(i, square(rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.choice([0.5, 4.0, 30.0]), rnd.choice([0.5, 6.0]))) for i in range(60)]
    shapes += [(60, [[(1.0, 1.0), (40.0, 1.0), (1.0, 40.0)]]), (61, [[(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 9.0)]])]
    shapes += [(62, [*square(0.0, 0.0, 50.0, 50.0), *square(5.0, 5.0, 30.0, 30.0)]), (63, [square(7.0, 7.0, 5.0, 5.0)[0] + [(7.0, 7.0)]])]
    areas = spark.createDataFrame(shapes, "fid long, geom array<array<struct<x:double,y:double>>>")
    upright = {r.fid for r in areas.filter(spatial._is_box(F.col("geom"), "polygon")).collect()}
    assert upright == {*range(60), 63}
    dots = spark.createDataFrame([(i, (rnd.uniform(0, 60), rnd.uniform(0, 60))) for i in range(400)], "fid long, geom struct<x:double,y:double>")
    cross = lambda a, b: a.select(F.struct("*").alias("a")).crossJoin(b.select(F.struct("*").alias("b")))
    exact = lambda ka, kb: spatial.intersects(F.col("a.geom"), ka, F.col("b.geom"), kb)
    want = pairs_of(cross(dots, areas).filter(exact("point", "polygon")))
    assert pairs_of(spatial.spatial_join(dots, areas)) == want
    assert pairs_of(spatial.spatial_join(areas, areas, "polygon", "polygon", self_join="fid")) == pairs_of(
        cross(areas, areas).filter(exact("polygon", "polygon")).filter("a.fid < b.fid"))
    found = {r.fid for r in spatial.extract_by_location(areas, dots, "fid").collect()}
    assert found == {b for _, b in want}
