"""Moving windows and nearest values against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import focal

PIXELS = "raster_id int, band int, row int, col int, value double"
GRID = "raster_id int, x0 double, y0 double, dx double, dy double, ncols int, nrows int, srid int, nodata double"


def cells(seed, nrows, ncols, share):
    rnd = random.Random(seed)
    return {(r, c): rnd.randint(-50, 50) / 4 for r in range(nrows) for c in range(ncols) if rnd.random() < share}


def frame(spark, held, extra=()):
    return spark.createDataFrame([(1, 1, r, c, v) for (r, c), v in held.items()] + list(extra), PIXELS)


def result(df, raster=1):
    rows = [r for r in df.collect() if r.raster_id == raster]
    assert len({(r.row, r.col) for r in rows}) == len(rows)
    return {(r.row, r.col): r.value for r in rows}


PLAIN = {"mean": statistics.fmean, "sum": sum, "min": min, "max": max, "range": lambda v: max(v) - min(v), "std": statistics.pstdev, "median": statistics.median, "count": len}


@pytest.mark.parametrize("tile, size", [(8, 3), (4, 7), (3, 9), (256, 1)])
@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_focal(spark, tile, size, statistic):
    held, reach = cells(1, 19, 23, 0.7), size // 2
    got = result(focal.focal(frame(spark, held), size, statistic, tile=tile))
    assert set(got) == set(held)
    for r, c in held:
        own = [held[i, j] for i in range(r - reach, r + reach + 1) for j in range(c - reach, c + reach + 1) if (i, j) in held]
        assert got[r, c] == pytest.approx(PLAIN[statistic](own), abs=1e-9)


def test_focal_statistics_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(focal, "HELD", 20)
    held = cells(2, 9, 8, 0.6)
    nothing = [(1, 1, r, c, v) for r in range(9) for c, v in zip(range(8), (None, float("nan"), -99.0, -99.0, None, -99.0, -99.0, None), strict=True) if (r, c) not in held]
    px = frame(spark, held, [*nothing, (2, 1, 0, 0, -99.0), (2, 1, 40, 40, 7.0), (1, 2, 0, 0, 3.0)])
    px = px.withColumn("value", F.col("value"))
    for name, plain in PLAIN.items():
        d = focal.focal(px, 3, name, -99.0, gaps=True, tile=4).filter("band = 1")
        want = {}
        for r in range(9):
            for c in range(8):
                own = [held[i, j] for i in range(r - 1, r + 2) for j in range(c - 1, c + 2) if (i, j) in held]
                if own:
                    want[r, c] = plain(own)
        got = result(d)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), name
        assert result(d, 2) == {(40, 40): {"range": 0.0, "std": 0.0, "count": 1.0}.get(name, 7.0)}
    weights = [[0, 1, 0], [1, 4, 1], [0, 1, 0]]
    got = result(focal.focal(px.filter("band = 1"), 3, weights=weights, nodata=-99.0, tile=4))
    for r, c in held:
        own = [(w, held[r + i - 1, c + j - 1]) for i, row in enumerate(weights) for j, w in enumerate(row) if (r + i - 1, c + j - 1) in held]
        assert got[r, c] == pytest.approx(sum(w * v for w, v in own) / sum(w for w, _ in own))
    assert result(focal.focal(frame(spark, {(0, 0): 5.0}), 3, weights=[[1, 1, 1], [1, 0, 1], [1, 1, 1]])) == {}
    assert focal.focal(px.limit(0)).count() == 0
    for wrong in ({"size": 4}, {"statistic": "best"}, {"weights": [[1]]}):
        with pytest.raises(ValueError):
            focal.focal(px, **wrong)


def test_rims_travel_alone(spark):
    """Rows shuffled beyond the pixels themselves follow the rims of the tiles."""
    px = spark.createDataFrame([(1, 1, r, c, 1.0) for r in range(64) for c in range(64)], PIXELS)
    plan = focal.focal(px, 3, tile=16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2
    d = px.select(F.size(F.array_distinct(F.array(F.floor((F.col("row") - 1) / 16), F.floor((F.col("row") + 1) / 16)))).alias("n"))
    assert d.agg(F.sum("n")).first()[0] < 64 * 64 * 1.15


@pytest.mark.parametrize("limit", [None, 2.5, 0])
@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_fill(spark, limit, share):
    nrows, ncols = 17, 13
    held = cells(3, nrows, ncols, share) or {(5, 5): 1.0}
    grids = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, ncols, nrows, 1, -99.0), (2, 0.0, 0.0, 1.0, 1.0, 4, 4, 1, -99.0)], GRID)
    px = frame(spark, held, [(1, 1, r, c, -99.0) for r in range(3) for c in range(ncols) if (r, c) not in held] + [(2, 1, 1, 1, -99.0), (1, 1, 99, 0, 5.0)])
    got = result(focal.fill_nodata(px, grids, limit))
    want = {}
    for r in range(nrows):
        for c in range(ncols):
            d, i, j = min(((i - r) ** 2 + (j - c) ** 2, i, j) for i, j in held)
            if limit is None or d <= limit**2:
                want[r, c] = held[i, j]
    assert got == want
    assert result(focal.fill_nodata(px, grids, limit), 2) == {}
