"""Regions of equal pixels, their outlines and dissolved polygons against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import outlines
from fieldspark.plans.connected import connected

PIXELS = "raster_id string, band int, row int, col int, value double"
REGION = ["raster_id", "band", "region_row", "region_col"]


def flood(held):
    """Name of each cell's region: its first cell."""
    names = {}
    for start in sorted(held):
        if start in names:
            continue
        names[start], stack = start, [start]
        while stack:
            r, c = stack.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in held and n not in names and held[n] == held[start]:
                    names[n] = start
                    stack.append(n)
    return names


def frame(spark, held):
    return spark.createDataFrame([("r", 1, r, c, float(v)) for (r, c), v in held.items()], PIXELS)


def checked(corners, cells):
    """The corners of one region are closed rings; their area and length are those of the cells."""
    rings = {}
    for r in corners:
        rings.setdefault((r.ring_x, r.ring_y, r.ring_way), []).append(r)
    area = length = 0
    for ring in rings.values():
        ring.sort(key=lambda r: r.place)
        assert [r.place for r in ring] == list(range(len(ring)))
        for a, b in zip(ring, ring[1:] + ring[:1]):
            assert (a.next_x, a.next_y) == (b.x, b.y)
            area += (a.next_x * a.y - a.x * a.next_y) / 2
            length += abs(a.next_x - a.x) + abs(a.next_y - a.y)
    sides = Counter()
    for r, c in cells:
        for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            sides[n in cells] += 1
    assert area == len(cells) and length == sides[False]
    return rings


def of_regions(names):
    found = {}
    for cell, name in names.items():
        found.setdefault(name, set()).add(cell)
    return found


def test_connected(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 180), rnd.randrange(100, 180)) for _ in range(60)] + [(7, None)]
    part = {}
    for a, b in links:
        if b is not None and a != b:
            part.setdefault(a, a), part.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            if b in part and a in part:
                part[a] = part[b] = min(part[a], part[b])
    got = {r.node: r.part for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == part


@pytest.mark.parametrize("tile", [5, 256])
def test_regions(spark, tile):
    """Random cells, a spiral and a ring around a hole, with rows and columns below zero."""
    rnd = random.Random(5)
    held = {(r, c): rnd.randrange(2) for r in range(-6, 12) for c in range(-4, 15) if rnd.random() < 0.95}
    held |= {(20 + r, c): 7 for r in range(9) for c in range(9) if r in (0, 8) or c in (0, 8) or (r, c) == (4, 4)}
    labelled = outlines.label_regions(frame(spark, held).union(spark.createDataFrame([("r", 1, 50, 50, None), ("r", 1, 51, 50, -9999.0)], PIXELS)), tile=tile)
    labelled = labelled.cache()
    names = flood(held)
    assert {(r.row, r.col): (r.region_row, r.region_col) for r in labelled.collect()} == names
    got = {}
    for r in outlines.region_outlines(labelled).collect():
        got.setdefault((r.region_row, r.region_col), []).append(r)
    cells = of_regions(names)
    assert set(got) == set(cells)
    rings = {name: checked(got[name], cells[name]) for name in cells}
    assert len(rings[20, 0]) == 2 and sum(map(len, rings[20, 0].values())) == 8


def test_pinched_rings_touch(spark):
    """Cells of one region that meet at a corner only there: rings touch and don't cross."""
    held = {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 1, (2, 0): 1, (2, 1): 1, (1, 2): 1, (2, 2): 2}
    labelled = outlines.label_regions(frame(spark, held))
    rows = outlines.region_outlines(labelled).filter("region_row = 0").collect()
    rings = checked(rows, {k for k, v in held.items() if v == 1})
    # (1, 2) and (2, 1) touch at a corner: the hole at (1, 1) is a ring of its own or part of the outer one, never crossed.
    assert sum(len(r) for r in rings.values()) == len(rows) and len(rings) in (1, 2)


def test_dissolve(spark):
    square = lambda r, c, turn: [[{"x": float(x), "y": float(y)} for x, y in ([(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1), (c, r)][:: -1 if turn else 1])]]
    rnd = random.Random(9)
    cells = {(r, c) for r in range(9) for c in range(9) if rnd.random() < 0.7}
    rows = [(1, square(r, c, (r + c) % 2)) for r, c in cells] + [(2, square(0, 0, False)), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "k int, geom array<array<struct<x: double, y: double>>>")
    found = outlines.dissolve(df, ["k"])
    got = found.collect()
    assert {r.k for r in got} == {1, 2}
    checked([r for r in got if r.k == 1], cells)
    two = outlines.ring_table(found.filter("k = 2"), ["k"]).collect()
    assert [(r.corners, r.area, r.perimeter) for r in two] == [(4, 1.0, 4.0)]


def test_on_grid(spark):
    labelled = outlines.label_regions(frame(spark, {(0, 0): 1, (0, 1): 1}))
    grid = spark.createDataFrame([("r", 100.0, 50.0, 10.0, 5.0)], "raster_id string, x0 double, y0 double, dx double, dy double")
    rows = outlines.on_grid(outlines.region_outlines(labelled), grid)
    assert {(r.x, r.y) for r in rows.collect()} == {(100.0, 50.0), (120.0, 50.0), (120.0, 45.0), (100.0, 45.0)}
    assert [r.area for r in outlines.ring_table(rows, REGION).collect()] == [100.0]


def test_no_rows(spark):
    empty = frame(spark, {(0, 0): 1}).limit(0)
    labelled = outlines.label_regions(empty)
    assert labelled.count() == 0 and outlines.region_outlines(labelled).count() == 0
    assert outlines.label_regions(frame(spark, {(0, 0): 1}).withColumn("value", F.lit(float("nan")))).count() == 0
