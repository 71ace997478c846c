"""Regions of equal pixels, their outlines, and polygons dissolved along common edges.

Regions are labelled tile by tile; only cells at tile borders make links between tiles, and the connected parts of these
links join the labels.  Outlines are what is left when sides met twice in opposite directions cancel.  Straight runs
of sides become one edge, the edges around each corner are put in order by their angle, which gives each edge its next one,
and the rings are ordered by pointer doubling, so no ring is ever gathered in a task.

Rings run clockwise around what they enclose (y upwards) and holes the other way; rings touch at a corner and never cross.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.geo import bind
from fieldspark.operators.raster import NODATA, valid
from fieldspark.plans.connected import connected
from fieldspark.plans.sizing import cut_lineage

#: Side of a tile in cells.
TILE = 256
_HIGH, _SHIFT = 2**32, 2**31
_LAYER = ["raster_id", "band"]


def _tile_labels(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each cell of a tile the smallest flat index of the equal cells it is connected with by sides."""
    index = np.arange(values.size).reshape(values.shape)
    right = known[:, :-1] & known[:, 1:] & (values[:, :-1] == values[:, 1:])
    down = known[:-1] & known[1:] & (values[:-1] == values[1:])
    a = np.concatenate([index[:, :-1][right], index[:-1][down]])
    b = np.concatenate([index[:, 1:][right], index[1:][down]])
    up = index.ravel().copy()
    while True:
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            return up.reshape(values.shape)
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up[up] != up).any():
            up = up[up]


def label_regions(pixels: DataFrame, nodata: float | None = NODATA, tile: int = TILE) -> DataFrame:
    """raster_id, band, row, col, value, region_row, region_col of all cells with data.

    Cells of equal value that touch at a side are one region, named by its first cell in order of row and column.
    A cell must occur once in a layer.  Null, NaN and nodata cells belong to no region and are left out."""
    cells = pixels.filter(valid(F.col("value"), nodata)).select(
        *_LAYER, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")
    )
    placed = cells.withColumns({"__tr": F.floor(F.col("row") / tile), "__tc": F.floor(F.col("col") / tile)})

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        r, c = rows["row"].to_numpy() - rows["__tr"].iloc[0] * tile, rows["col"].to_numpy() - rows["__tc"].iloc[0] * tile
        values, known = np.zeros((tile, tile)), np.zeros((tile, tile), bool)
        values[r, c], known[r, c] = rows["value"].to_numpy(), True
        first = _tile_labels(values, known)[r, c]
        top, left = rows["__tr"].iloc[0] * tile, rows["__tc"].iloc[0] * tile
        rows["name"] = (first // tile + top).astype(np.int64) * _HIGH + first % tile + left + _SHIFT
        return rows[[*_LAYER, "row", "col", "value", "name"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    named = cut_lineage(placed.groupBy(*_LAYER, "__tr", "__tc").applyInPandas(label, f"{kinds}, name long"))
    node = F.struct(*_LAYER, "name")
    links = None
    for axis in ("row", "col"):
        other = "col" if axis == "row" else "row"
        ends = named.filter(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select(
            *_LAYER, (F.col(axis) + 1).alias(axis), other, "value", node.alias("a")
        )
        begins = named.filter(F.pmod(F.col(axis), F.lit(tile)) == 0).select(*_LAYER, axis, other, "value", node.alias("b"))
        met = ends.join(begins, [*_LAYER, axis, other, "value"]).select("a", "b")
        links = met if links is None else links.union(met)
    parts = connected(links).select(*[F.col(f"node.{c}").alias(c) for c in (*_LAYER, "name")], F.col("part.name").alias("__part"))
    joined = named.join(parts, [*_LAYER, "name"], "left").withColumn("name", F.coalesce("__part", "name"))
    return joined.select(
        *_LAYER, "row", "col", "value",
        F.floor(F.col("name") / _HIGH).cast("int").alias("region_row"), (F.pmod("name", F.lit(_HIGH)) - _SHIFT).cast("int").alias("region_col"),
    )


def _left_over(edges: DataFrame, keys: Seq[str]) -> DataFrame:
    """Edges (ax, ay, bx, by) that no edge of the same keys and the other direction takes back."""
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    way = F.when(forward, 1).otherwise(-1)
    sums = edges.select(
        *keys, pick("ax", "bx").alias("px"), pick("ay", "by").alias("py"), pick("bx", "ax").alias("qx"), pick("by", "ay").alias("qy"), way.alias("way")
    ).groupBy(*keys, "px", "py", "qx", "qy").agg(F.sum("way").alias("way")).filter("way <> 0")
    on = F.col("way") > 0
    side = lambda x, y, name: F.when(on, F.col(x)).otherwise(F.col(y)).alias(name)
    return sums.select(*keys, side("px", "qx", "ax"), side("py", "qy", "ay"), side("qx", "px", "bx"), side("qy", "py", "by"))


def _runs(edges: DataFrame, keys: Seq[str]) -> DataFrame:
    """Unit sides of a grid with those that follow each other straight on put together."""
    flat = F.col("ay") == F.col("by")
    line, start = F.when(flat, F.col("ay")).otherwise(F.col("ax")), F.when(flat, F.least("ax", "bx")).otherwise(F.least("ay", "by"))
    way = F.when(flat, F.col("bx") - F.col("ax")).otherwise(F.col("by") - F.col("ay"))
    d = edges.select(*keys, flat.alias("flat"), line.alias("line"), way.alias("way"), start.alias("at"))
    on = [*keys, "flat", "line", "way"]
    run = d.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*on).orderBy("at")))
    ends = run.groupBy(*on, "run").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    first = F.when(F.col("way") > 0, F.col("low")).otherwise(F.col("high"))
    last = F.when(F.col("way") > 0, F.col("high")).otherwise(F.col("low"))
    at = lambda v, x: F.when(F.col("flat") == x, v).otherwise(F.col("line"))
    return ends.select(*keys, at(first, True).alias("ax"), at(first, False).alias("ay"), at(last, True).alias("bx"), at(last, False).alias("by"))


def stitch(edges: DataFrame, keys: Seq[str]) -> DataFrame:
    """keys, ring_x, ring_y, ring_way, place, x, y, next_x, next_y: the edges as rings, a row for each corner.

    Edges have what they enclose on their right.  A ring is known by the smallest corner it begins with and the angle of
    its first edge; place counts its corners from 0."""
    keys = list(keys)
    edge = F.struct("ax", "ay", "bx", "by")
    ray = lambda x, y, to_x, to_y, comes: edges.select(
        *keys, F.col(x).alias("vx"), F.col(y).alias("vy"), F.atan2(F.col(to_y) - F.col(y), F.col(to_x) - F.col(x)).alias("angle"),
        edge.alias("edge"), F.lit(comes).alias("comes"),
    )
    around = Window.partitionBy(*keys, "vx", "vy").orderBy("angle")
    following = F.coalesce(F.lead("edge").over(around), F.first("edge").over(around))
    rays = ray("bx", "by", "ax", "ay", True).union(ray("ax", "ay", "bx", "by", False))
    state = rays.withColumn("to", following).filter("comes").select(
        *keys, "edge", "to", F.col("edge").alias("low"), F.lit(0).cast("long").alias("steps")
    )
    state, reach = cut_lineage(state), 1
    while True:
        ahead = state.select(*keys, F.col("edge").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low"), F.col("steps").alias("__steps"))
        lower = F.col("__low") < F.col("low")
        moved = state.join(ahead, [*keys, "to"]).select(
            *keys, "edge", F.col("__to").alias("to"), F.when(lower, F.col("__low")).otherwise(F.col("low")).alias("low"),
            F.when(lower, F.col("__steps") + reach).otherwise(F.col("steps")).alias("steps"), lower.alias("lower"),
        )
        moved = cut_lineage(moved)
        state, reach = moved.drop("lower"), 2 * reach
        if moved.filter("lower").isEmpty():
            break
    sizes = state.groupBy(*keys, "low").agg(F.count("*").alias("n"))
    return state.join(sizes, [*keys, "low"]).select(
        *keys, F.col("low.ax").alias("ring_x"), F.col("low.ay").alias("ring_y"),
        F.atan2(F.col("low.by") - F.col("low.ay"), F.col("low.bx") - F.col("low.ax")).alias("ring_way"),
        ((F.col("n") - F.col("steps")) % F.col("n")).alias("place"),
        F.col("edge.ax").alias("x"), F.col("edge.ay").alias("y"), F.col("edge.bx").alias("next_x"), F.col("edge.by").alias("next_y"),
    )


def region_outlines(labelled: DataFrame) -> DataFrame:
    """The outlines of labelled regions as stitched corners, x the column and y minus the row of a corner."""
    keys = [*_LAYER, "region_row", "region_col"]
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    corner = [(col, -row), (col + 1, -row), (col + 1, -row - 1), (col, -row - 1)]
    sides = [
        F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
        for a, b in zip(corner, corner[1:] + corner[:1], strict=True)
    ]
    edges = labelled.select(*keys, F.explode(F.array(*sides)).alias("e")).select(*keys, "e.*")
    return stitch(_runs(_left_over(edges, keys), keys), keys)


def on_grid(outlines: DataFrame, grids: DataFrame) -> DataFrame:
    """Corners of region outlines in the coordinates of their rasters' grids."""
    g = grids.select("raster_id", "x0", "y0", "dx", "dy")
    x = lambda c: F.col("x0") + F.col(c) * F.col("dx")
    y = lambda c: F.col("y0") + F.col(c) * F.col("dy")
    moved = {c: x(c) for c in ("x", "next_x", "ring_x")} | {c: y(c) for c in ("y", "next_y", "ring_y")}
    return outlines.join(g, "raster_id").withColumns(moved).drop("x0", "y0", "dx", "dy")


def ring_table(outlines: DataFrame, keys: Seq[str]) -> DataFrame:
    """keys, ring_x, ring_y, ring_way, corners, area (of holes negative), perimeter."""
    cross = F.col("next_x") * F.col("y") - F.col("x") * F.col("next_y")
    return outlines.groupBy(*keys, "ring_x", "ring_y", "ring_way").agg(
        F.count("*").alias("corners"), (F.sum(cross.cast("double")) / 2).alias("area"),
        F.sum(F.hypot(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))).alias("perimeter"),
    )


def _turned(ring: Column, outer: Column) -> Column:
    """The ring without its closing corner, clockwise if it is an outer one and the other way if not."""
    is_closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    def area(v: Column) -> Column:
        following = F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
        return F.aggregate(F.zip_with(v, following, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, t: s + t)

    return bind(
        F.when(is_closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring),
        lambda v: F.when((area(v) < 0) == outer, v).otherwise(F.reverse(v)),
    )


def dissolve(polygons: DataFrame, keys: Seq[str], rings: str = "geom") -> DataFrame:
    """Polygons of equal keys as one: stitched corners of what is left when their common edges cancel.

    rings holds arrays of points, the outer one first.  Polygons of equal keys may share whole edges but not overlap;
    edges that lie on each other in part do not cancel.  Null and empty geometries add nothing."""
    keys = list(keys)
    each = polygons.select(*keys, F.posexplode(rings).alias("__i", "__ring")).filter("size(__ring) > 2")
    turned = each.select(*keys, _turned(F.col("__ring"), F.col("__i") == 0).alias("v"))
    # Negative zero would part equal corners.
    value = lambda p, c, name: (p[c].cast("double") + F.lit(0.0)).alias(name)
    pair = lambda p, q: F.struct(value(p, "x", "ax"), value(p, "y", "ay"), value(q, "x", "bx"), value(q, "y", "by"))
    sides = F.zip_with("v", F.concat(F.expr("slice(v, 2, size(v))"), F.expr("slice(v, 1, 1)")), pair)
    edges = turned.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*").filter("ax <> bx or ay <> by")
    return stitch(_left_over(edges, keys), keys)
