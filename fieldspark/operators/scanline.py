"""Polygons on pixel grids by scanlines: edges cross rows of pixel centres, sorted crossings are spans of pixels.

A centre is inside where an odd number of edges crosses its row to the right of it (so holes are outside), hence between
the first and second, third and fourth ... crossing of the row.  Each edge is listed only in the rows it crosses and a
row's crossings meet in one small group: the cost follows edges and output, not pixels times vertices, and a ring of any
number of vertices is spread over its rows.  Spans meet pixels by an equi join on (raster, row, block of columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators.spatial import BOX, _closed, _edges, box_join, with_box
from fieldspark.plans.keyjoin import join_on

# Columns of one block that spans and pixels meet in.
BLOCK = 64
_GRID = ("x0", "y0", "dx", "dy", "ncols", "nrows")


def extents(grids: DataFrame) -> DataFrame:
    """Grids with the boxes they cover."""
    return grids.withColumns(
        {
            "xmin": F.col("x0"),
            "ymin": F.col("y0") - F.col("nrows") * F.col("dy"),
            "xmax": F.col("x0") + F.col("ncols") * F.col("dx"),
            "ymax": F.col("y0"),
        }
    )


def _placed(masks: DataFrame, grids: DataFrame, feature: str, rings: str, margin: float) -> DataFrame:
    """A row for each distinct mask and raster that meet: mask key, copies, rings and the grid.

    Equal masks of one feature are one row with a count, as crossings of both would cancel."""
    rows = masks.select(F.col(feature).alias("feature"), F.col(rings).alias("rings"))
    key = F.concat_ws("-", F.hex(F.xxhash64("rings")), F.hex(F.xxhash64(F.lit(1), "rings")))
    distinct = rows.withColumn("mask", key).groupBy("feature", "mask").agg(F.first("rings").alias("rings"), F.count(F.lit(1)).alias("copies"))
    boxed = with_box(distinct, "rings").drop("rings")
    g = extents(grids.select("raster_id", *_GRID))
    if margin:
        # Grids grow instead of masks: each by so many of its own cells.
        pad = margin * F.greatest("dx", "dy")
        g = g.withColumns({c: F.col(c) - pad if c.endswith("min") else F.col(c) + pad for c in BOX})
    pairs = box_join(boxed, g).select(
        "a.feature", "a.mask", "a.copies", "b.raster_id", *[F.col(f"b.{c}").alias(c) for c in _GRID]
    )
    # Rings travel once for each raster they meet, not for each cell of the join.
    return join_on(pairs, distinct.select("feature", "mask", "rings"), ["feature", "mask"])


def _rows_between(low: Column, high: Column) -> Column:
    """Rows whose centres may lie between two heights; one more at either end for rounding."""
    first = F.greatest(F.floor((F.col("y0") - high) / F.col("dy") - 0.5), F.lit(0).cast("long"))
    last = F.least(F.ceil((F.col("y0") - low) / F.col("dy") - 0.5), F.col("nrows").cast("long") - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _centre_x(col: Column) -> Column:
    return F.col("x0") + (col + 0.5) * F.col("dx")


def _centre_y(row: Column) -> Column:
    return F.col("y0") - (row + 0.5) * F.col("dy")


def _first_at(x: Column) -> Column:
    """The first column whose centre is not left of x."""
    guess = F.ceil((x - F.col("x0")) / F.col("dx") - 0.5)
    return F.when(_centre_x(guess - 1) >= x, guess - 1).when(_centre_x(guess) < x, guess + 1).otherwise(guess)


def _clipped(d: DataFrame, first: Column, last: Column) -> DataFrame:
    d = d.withColumns({"first": F.greatest(first, F.lit(0).cast("long")), "last": F.least(last, F.col("ncols").cast("long") - 1)})
    return d.filter("first <= last").select(
        "raster_id", F.col("row").cast("int").alias("row"), F.col("first").cast("int").alias("first"),
        F.col("last").cast("int").alias("last"), "feature", "mask", "copies",
    )


def polygon_spans(
    masks: DataFrame, grids: DataFrame, feature: str = "fid", rings: str = "rings", margin: float = 0.0
) -> DataFrame:
    """raster_id, row, first, last, feature, mask, copies: pixels whose centres lie in a polygon, as spans of columns.

    ``margin`` adds pixels whose centres are within that many pixels of an edge; spans of one polygon may then overlap.
    Spans of one polygon never overlap otherwise.  Masks without rings or with null ones give nothing.
    """
    placed = _placed(masks, grids, feature, rings, margin)
    e, keep = F.col("_e"), ["raster_id", "feature", "mask", "copies", *_GRID]
    edges = placed.select(*keep, F.explode(_edges(_closed(F.col("rings")))).alias("_e"))
    crossed = edges.withColumn("row", F.explode(_rows_between(F.least(e.p.y, e.q.y), F.greatest(e.p.y, e.q.y))))
    y = _centre_y(F.col("row"))
    crossed = crossed.filter((e.p.y > y) != (e.q.y > y))
    x = (e.q.x - e.p.x) * (y - e.p.y) / (e.q.y - e.p.y) + e.p.x
    sides = crossed.groupBy(*keep, "row").agg(F.sort_array(F.collect_list(x)).alias("_x"))
    ends = F.transform(
        F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda i: F.struct(F.get("_x", i).alias("a"), F.get("_x", i + 1).alias("b"))
    )
    inside = sides.filter(F.size("_x") > 1).withColumn("_s", F.explode(ends))
    spans = _clipped(inside, _first_at(F.col("_s.a")), _first_at(F.col("_s.b")) - 1)
    if not margin:
        return spans
    reach = margin * F.greatest("dx", "dy")
    near = edges.withColumn("_reach", reach).withColumn(
        "row", F.explode(_rows_between(F.least(e.p.y, e.q.y) - reach, F.greatest(e.p.y, e.q.y) + reach))
    )
    # The part of the edge within reach of the row bounds the columns; each is tested exactly then.
    rise = e.q.y - e.p.y
    at = lambda edge: F.when(rise == 0, F.lit(0.0)).otherwise((edge - e.p.y) / rise)
    lo, hi = at(y - F.col("_reach")), at(y + F.col("_reach"))
    part = lambda t: e.p.x + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (e.q.x - e.p.x)
    ends_x = F.when(rise == 0, F.array(e.p.x, e.q.x)).otherwise(F.array(part(lo), part(hi)))
    near = near.withColumn("_ends", ends_x)
    first = F.greatest(_first_at(F.array_min("_ends") - F.col("_reach")) - 1, F.lit(0).cast("long"))
    last = F.least(_first_at(F.array_max("_ends") + F.col("_reach")), F.col("ncols").cast("long") - 1)
    near = near.withColumn("_c", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    ring = F.array(F.array(e.p, e.q))
    close = near.filter(geo.ring_distance(_centre_x(F.col("_c")), y, ring) <= F.col("_reach"))
    return spans.unionByName(_clipped(close, F.col("_c"), F.col("_c")))


def on_pixels(pixels: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels joined with the spans that hold them; ``left_semi`` keeps each pixel in any span once."""
    cells = spans.withColumn("_cb", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))))
    cells = cells.withColumnsRenamed({"raster_id": "_raster", "row": "_row", "_cb": "_block"})
    block = F.floor(pixels["col"] / BLOCK)
    meet = (
        (pixels["raster_id"] == cells["_raster"]) & (pixels["row"] == cells["_row"]) & (block == cells["_block"])
        & pixels["col"].between(cells["first"], cells["last"])
    )
    return pixels.join(cells, meet, how)


def rasterize_polygons(
    features: DataFrame, grids: DataFrame, value: str = "value", feature: str = "fid", rings: str = "rings", band: int = 1
) -> DataFrame:
    """Pixels of every grid whose centres lie in a polygon, with its value; where several do, the largest feature's.

    Pixels in no polygon have no row.  A null value burns null."""
    spans = polygon_spans(features, grids, feature, rings)
    cells = spans.withColumn("col", F.explode(F.sequence("first", "last"))).select("raster_id", "row", "col", "feature")
    top = cells.groupBy("raster_id", "row", "col").agg(F.max("feature").alias("feature"))
    # One value a feature: the largest where its rows differ.
    values = features.groupBy(F.col(feature).alias("feature")).agg(F.max(value).cast("double").alias("value"))
    return top.join(values, "feature").select("raster_id", F.lit(band).alias("band"), "row", "col", "value")
