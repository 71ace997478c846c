"""Point sampling, mask clipping and zonal statistics on pixel tables."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.crs import transform_point
from fieldspark.operators.fields import short_names
from fieldspark.operators.raster import PIXEL
from fieldspark.operators.scanline import extents, on_pixels, polygon_spans
from fieldspark.operators.spatial import box_join, with_box
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.sizing import broadcast_if_small


def sample_long(
    points: DataFrame,
    pixels: DataFrame,
    grids: DataFrame,
    key: str = "fid",
    x: str = "x",
    y: str = "y",
    srid: int | None = None,
) -> DataFrame:
    """(point, raster, value) for every raster cell that holds a point.

    Points are moved to each raster's system first when ``srid`` is given.
    """
    srids = [r[0] for r in grids.select("srid").distinct().collect()] if srid else [None]
    found = None
    for s in srids:
        # Points meet the extents of one system's rasters by grid cells, never all with all.
        moved = s is not None and s != srid
        pos = transform_point(F.col(x), F.col(y), srid, s) if moved else geo.point(F.col(x), F.col(y))
        at = points.select(key, pos.alias("_p"))
        boxes = with_box(at.filter(F.col("_p.x").isNotNull() & F.col("_p.y").isNotNull()), "_p", "point")
        own = grids if s is None else grids.filter(F.col("srid") == s)
        pairs = box_join(boxes, extents(own), points="a")
        found = pairs if found is None else found.unionByName(pairs)
    d = found.select(
        F.col(f"a.{key}").alias(key),
        F.col("b.raster_id").alias("raster_id"),
        F.floor((F.col("a._p.x") - F.col("b.x0")) / F.col("b.dx")).alias("col"),
        F.floor((F.col("b.y0") - F.col("a._p.y")) / F.col("b.dy")).alias("row"),
        F.col("b.ncols").alias("ncols"),
        F.col("b.nrows").alias("nrows"),
    )
    inside = (
        (F.col("col") >= 0)
        & (F.col("row") >= 0)
        & (F.col("col") < F.col("ncols"))
        & (F.col("row") < F.col("nrows"))
    )
    d = d.filter(inside).select(
        key, "raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")
    )
    band1 = pixels.filter(F.col("band") == 1).select("raster_id", "row", "col", "value")
    return d.join(band1, ["raster_id", "row", "col"]).select(key, "raster_id", "value")


def sample_rasters(
    points: DataFrame,
    pixels: DataFrame,
    grids: DataFrame,
    key: str = "fid",
    x: str = "x",
    y: str = "y",
    srid: int | None = None,
    raster_ids: Seq | None = None,
    prefix: str = "",
    max_len: int = 10,
) -> DataFrame:
    """One column per raster with its value under each point, null outside."""
    ids = list(raster_ids) if raster_ids is not None else sorted(
        r[0] for r in grids.select("raster_id").distinct().collect()
    )
    names = short_names([f"{prefix}{i}" for i in ids], points.columns, max_len)
    long = sample_long(points, pixels, grids, key, x, y, srid)
    wide = long.groupBy(key).agg(
        *[F.max(F.when(F.col("raster_id") == i, F.col("value"))).alias(n) for i, n in zip(ids, names)]
    )
    return join_on(points, wide, [key], "left")


def altimetry(
    points: DataFrame, dem: DataFrame, grids: DataFrame, key: str = "fid", x: str = "x", y: str = "y",
    srid: int | None = None, out: str = "elevation",
) -> DataFrame:
    """Ground height under each point; the first elevation raster that covers it."""
    long = sample_long(points, dem, grids, key, x, y, srid)
    one = long.groupBy(key).agg(F.min_by("value", "raster_id").alias(out))
    return join_on(points, one, [key], "left")


def clip_raster(
    pixels: DataFrame,
    grids: DataFrame,
    masks: DataFrame,
    feature: str = "fid",
    rings: str = "rings",
    per_feature: bool = False,
    buffer_pixels: float = 0.0,
) -> DataFrame:
    """Pixels whose centre lies in a mask polygon, all together or per feature.

    ``buffer_pixels`` also keeps centres within that many pixels of a mask edge.  Masks reach the pixels as spans of
    columns, so a mask of any number of vertices costs its crossings with the rows of pixels.
    """
    spans = polygon_spans(masks, grids, feature, rings, buffer_pixels)
    if not per_feature:
        return on_pixels(pixels, spans, "left_semi").select(*PIXEL)
    hits = on_pixels(pixels, spans)
    if buffer_pixels:
        hits = hits.dropDuplicates(["feature", "mask", "raster_id", "band", "row", "col"])
    # Equal masks of one feature count as often as they are there.
    return hits.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("feature", *PIXEL)


def clip_extent(
    pixels: DataFrame, grids: DataFrame, extent: tuple[float, float, float, float], srid: int = 4326
) -> DataFrame:
    """Pixels inside the envelope of a geographic extent, per raster system."""
    xmin, ymin, xmax, ymax = extent
    srids = [r[0] for r in grids.select("srid").distinct().collect()]
    box = F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    for s in srids:
        corners = F.array(
            *[
                transform_point(F.lit(x), F.lit(y), 4326, s)
                for x, y in ((xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax))
            ]
        )
        xs, ys = F.transform(corners, lambda p: p.x), F.transform(corners, lambda p: p.y)
        env = F.struct(
            F.array_min(xs).alias("xmin"),
            F.array_min(ys).alias("ymin"),
            F.array_max(xs).alias("xmax"),
            F.array_max(ys).alias("ymax"),
        )
        box = F.when(F.col("srid") == s, env).otherwise(box)
    g = grids.withColumn("_e", box)
    d = join_on(pixels, broadcast_if_small(g), ["raster_id"])
    x = F.col("x0") + (F.col("col") + 0.5) * F.col("dx")
    y = F.col("y0") - (F.col("row") + 0.5) * F.col("dy")
    keep = x.between(F.col("_e.xmin"), F.col("_e.xmax")) & y.between(F.col("_e.ymin"), F.col("_e.ymax"))
    return d.filter(keep).select(*PIXEL)


def assert_overlap(grids: DataFrame, masks: DataFrame, feature: str = "fid", rings: str = "rings"):
    """The masks that touch a raster; an error when none does."""
    hits = box_join(with_box(masks, rings), extents(grids)).select(F.col(f"a.{feature}").alias(feature)).distinct()
    if not hits.head(1):
        raise ValueError("no mask feature overlaps the rasters")
    return masks.join(hits, feature, "left_semi")


def zonal_statistics(pixels: DataFrame, grids: DataFrame, zones: DataFrame, **options) -> DataFrame:
    """Count, sum, mean, min, max and deviation of the pixels of every zone and raster."""
    d = clip_raster(pixels, grids, zones, per_feature=True, **options)
    v = F.col("value")
    return d.groupBy("feature", "raster_id", "band").agg(
        F.count(v).alias("count"),
        F.sum(v).alias("sum"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
    )


def rasterize_points(points: DataFrame, grid: dict, x: str = "x", y: str = "y", value: str | None = None):
    """Points counted (or their values averaged) per cell of a grid."""
    col = F.floor((F.col(x) - grid["x0"]) / grid["dx"]).cast("int")
    row = F.floor((grid["y0"] - F.col(y)) / grid["dy"]).cast("int")
    d = points.select(row.alias("row"), col.alias("col"), *([value] if value else []))
    d = d.filter(
        F.col("row").between(0, grid["nrows"] - 1) & F.col("col").between(0, grid["ncols"] - 1)
    )
    agg = F.avg(value) if value else F.count(F.lit(1)).cast("double")
    return d.groupBy("row", "col").agg(agg.alias("value"))
