"""Resampling and regridding of pixel tables, within one coordinate system.

Each source pixel works out which target cells it feeds, so no neighbour join is
needed: nearest is a plain projection, the kernels one grouped sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.raster import valid
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.quantiles import order_statistics
from fieldspark.plans.sizing import broadcast_if_small

_KEYS = ["raster_id", "band", "row", "col"]


@dataclass(frozen=True)
class Grid:
    """Top-left corner, cell size and shape of a target grid."""

    x0: float
    y0: float
    dx: float
    dy: float
    ncols: int
    nrows: int


def grid_of(grids: DataFrame, raster_id) -> Grid:
    """The grid of one raster."""
    row = grids.filter(F.col("raster_id") == raster_id).first()
    if row is None:
        raise ValueError(f"no grid of raster {raster_id}")
    return Grid(row["x0"], row["y0"], row["dx"], row["dy"], row["ncols"], row["nrows"])


def with_cell(g: Grid, cell: float) -> Grid:
    """The same corner and extent in square cells of another size; the last ones may reach beyond it."""
    count = lambda n, size: max(1, math.ceil(n * size / cell - 1e-9))
    return Grid(g.x0, g.y0, cell, cell, count(g.ncols, g.dx), count(g.nrows, g.dy))


def finest_grid(grids: DataFrame) -> Grid:
    """Cells of the finest width and height over the common extent of all rasters."""
    right, bottom = F.col("x0") + F.col("ncols") * F.col("dx"), F.col("y0") - F.col("nrows") * F.col("dy")
    e = grids.agg(
        F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.min("dx").alias("dx"), F.min("dy").alias("dy"),
        F.max(right).alias("x1"), F.min(bottom).alias("y1"), F.count_distinct("srid").alias("systems"),
    ).first()
    if e.x0 is None:
        raise ValueError("no rasters")
    if e.systems > 1:
        raise ValueError("rasters of several systems; reproject them first")
    count = lambda span, size: max(1, math.ceil(span / size - 1e-9))
    return Grid(e.x0, e.y0, e.dx, e.dy, count(e.x1 - e.x0, e.dx), count(e.y0 - e.y1, e.dy))


def _with_grid(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    g = grids.select(
        "raster_id",
        F.col("x0").alias("_x0"),
        F.col("y0").alias("_y0"),
        F.col("dx").alias("_dx"),
        F.col("dy").alias("_dy"),
        F.col("ncols").alias("_nc"),
        F.col("nrows").alias("_nr"),
        F.col("nodata").alias("_nd"),
    )
    d = join_on(pixels, broadcast_if_small(g), ["raster_id"])
    return d.filter(valid(F.col("value"), F.col("_nd")))


def _axes(t: Grid) -> tuple[tuple, tuple]:
    """Per axis: source index, offset of the source origin from the target's, sizes, counts."""
    col = (F.col("col"), F.col("_x0") - t.x0, F.col("_dx"), t.dx, t.ncols, F.col("_nc"))
    row = (F.col("row"), t.y0 - F.col("_y0"), F.col("_dy"), t.dy, t.nrows, F.col("_nr"))
    return row, col


def _span(lo: Column, hi: Column, count: int) -> Column:
    """Target indices lo..hi inside the grid as an array, empty when there are none."""
    lo = F.greatest(lo.cast("bigint"), F.lit(0).cast("bigint"))
    hi = F.least(hi.cast("bigint"), F.lit(count - 1).cast("bigint"))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _explode(d: DataFrame, rows: Column, cols: Column) -> DataFrame:
    d = d.withColumn("_tr", F.explode(rows))
    return d.withColumn("_tc", F.explode(cols))


def _nearest(d: DataFrame, t: Grid) -> DataFrame:
    spans = []
    for c, off, size, tsize, count, _ in _axes(t):
        lo = F.ceil((off + c * size) / tsize - 0.5)
        hi = F.ceil((off + (c + 1) * size) / tsize - 0.5) - 1
        spans.append(_span(lo, hi, count))
    return _explode(d, *spans).select(
        "raster_id",
        "band",
        F.col("_tr").cast("int").alias("row"),
        F.col("_tc").cast("int").alias("col"),
        "value",
    )


def _kernel(method: str, u: Column) -> Column:
    a = F.abs(u)
    if method == "bilinear":
        return F.greatest(1.0 - a, F.lit(0.0))
    if method == "cubic":
        near = 1.5 * a * a * a - 2.5 * a * a + 1.0
        far = -0.5 * a * a * a + 2.5 * a * a - 4.0 * a + 2.0
        return F.when(a <= 1, near).when(a < 2, far).otherwise(0.0)
    if method == "cubic_spline":
        near = (4.0 - 6.0 * a * a + 3.0 * a * a * a) / 6.0
        far = F.pow(2.0 - a, 3) / 6.0
        return F.when(a <= 1, near).when(a < 2, far).otherwise(0.0)
    x = a * math.pi
    lanczos = F.sin(x) / x * F.sin(x / 3.0) / (x / 3.0)
    return F.when(a < 1e-12, 1.0).when(a < 3, lanczos).otherwise(0.0)


_REACH = {"bilinear": 1.0, "cubic": 2.0, "cubic_spline": 2.0, "lanczos": 3.0}


def _convolve(d: DataFrame, t: Grid, method: str) -> DataFrame:
    spans, weights, inside = [], [], F.lit(True)
    for (c, off, size, tsize, count, src_count), name in zip(_axes(t), ("_tr", "_tc")):
        stretch = F.greatest(F.lit(1.0), F.lit(tsize) / size)
        reach = _REACH[method] * stretch
        lo = F.ceil((off + (c + 0.5 - reach) * size) / tsize - 0.5)
        hi = F.floor((off + (c + 0.5 + reach) * size) / tsize - 0.5)
        spans.append(_span(lo, hi, count))
        u = ((F.col(name) + 0.5) * tsize - off) / size - 0.5
        weights.append(_kernel(method, (u - c) / stretch))
        inside = inside & (u >= -0.5) & (u <= src_count - 0.5)
    e = _explode(d, *spans).filter(inside)
    e = e.withColumn("_w", weights[0] * weights[1]).filter(F.col("_w") != 0)
    return (
        e.groupBy("raster_id", "band", F.col("_tr").cast("int").alias("row"), F.col("_tc").cast("int").alias("col"))
        .agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
        .filter(F.col("value").isNotNull())
    )


def _blocks(d: DataFrame, t: Grid, method: str) -> DataFrame:
    at = []
    for c, off, size, tsize, count, _ in _axes(t):
        at.append(F.floor((off + (c + 0.5) * size) / tsize).cast("int"))
    cells = d.select("raster_id", "band", at[0].alias("row"), at[1].alias("col"), "value").filter(
        F.col("row").between(0, t.nrows - 1) & F.col("col").between(0, t.ncols - 1)
    )
    return cell_statistics(cells, method)


def cell_statistics(cells: DataFrame, method: str) -> DataFrame:
    """One statistic of all values of a target cell."""
    simple = {"average": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if method in simple:
        return cells.groupBy(*_KEYS).agg(simple[method]("value").alias("value"))
    if method == "mode":
        counts = cells.groupBy(*_KEYS, "value").agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*_KEYS).agg(
            F.max_by("value", F.struct("_n", -F.col("value"))).alias("value")
        )
    q = {"median": 0.5, "q1": 0.25, "q3": 0.75}[method]
    return order_statistics(cells, _KEYS, "value", {"value": q})


METHODS = ("nearest", *_REACH, "average", "sum", "min", "max", "mode", "median", "q1", "q3")


def resample(
    pixels: DataFrame, grids: DataFrame, target: Grid, method: str = "nearest", srid: int | None = None
) -> DataFrame:
    """Pixels of every raster on the target grid; nodata pixels do not contribute.

    ``srid`` is the system of the target grid: rasters of another one are reprojected."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if srid is not None:
        from fieldspark.operators.warp import reproject_raster

        other = grids.filter(F.col("srid") != srid)
        if other.head(1):
            own = grids.filter(F.coalesce(F.col("srid") == srid, F.lit(True)))
            moved = reproject_raster(pixels, other, target, srid, method)
            return resample(pixels, own, target, method).select(*_KEYS, "value").unionByName(moved)
    d = _with_grid(pixels, grids)
    if method == "nearest":
        return _nearest(d, target)
    if method in _REACH:
        return _convolve(d, target, method)
    return _blocks(d, target, method)
