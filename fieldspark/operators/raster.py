"""Raster algebra on pixel tables (raster_id, band, row, col, value) and tile tables."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.quantiles import order_statistics, quantiles_of, sketches

NODATA = -9999.0
CELL = ("row", "col")
PIXEL = ("raster_id", "band", "row", "col", "value")


def valid(value: Column, nodata: Column | float | None, tolerance: float = 1e-4) -> Column:
    """Neither null, NaN nor within ``tolerance`` of the nodata value."""
    ok = value.isNotNull() & ~F.isnan(value)
    if nodata is None:
        return ok
    nd = F.lit(nodata) if not isinstance(nodata, Column) else nodata
    return ok & F.coalesce(F.abs(value - nd) > tolerance, F.lit(True))


def layer(raster_id=None, band: int | None = 1) -> Column:
    """Condition that picks one layer of a pixel table; band None takes all bands."""
    cond = F.lit(True)
    if raster_id is not None:
        cond = cond & (F.col("raster_id") == raster_id)
    if band is not None:
        cond = cond & (F.col("band") == band)
    return cond


def align(
    pixels: DataFrame,
    layers: dict[str, Column],
    keys: Seq[str] = CELL,
    grids: DataFrame | None = None,
    to=None,
    bilinear: Seq[str] = (),
) -> DataFrame:
    """Put layers on the same grid side by side, one column each.

    Without ``grids`` the rasters share one grid.  With them every layer is put on the grid ``to`` (or that of the
    raster ``to``) by world position, those named in ``bilinear`` by that kernel and the others by the nearest cell, and pixels
    without data count as absent.  One scan and one shuffle on the cell whatever the number of layers.  A layer
    that has several pixels in a cell is an error: its condition leaves out the raster or the band.
    """
    keep = F.lit(False)
    for cond in layers.values():
        keep = keep | cond
    chosen = pixels.filter(keep)
    if grids is not None:
        from fieldspark.operators.resample import Grid, grid_of, resample

        target = to if isinstance(to, Grid) else grid_of(grids, to)
        parts = []
        for method in ("nearest", "bilinear"):
            names = [n for n in layers if (n in bilinear) == (method == "bilinear")]
            if names:
                own = F.lit(False)
                for n in names:
                    own = own | layers[n]
                part = resample(chosen.filter(own).select(*PIXEL), grids, target, method)
                parts.append(part.withColumn("_by", F.lit(method)))
        chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        layers = {
            n: c & (F.col("_by") == ("bilinear" if n in bilinear else "nearest")) for n, c in layers.items()
        }
    several = F.raise_error(F.lit("a layer has several pixels in one cell; name its raster and band")).cast("double")
    return chosen.groupBy(*keys).agg(
        *[
            F.when(F.count_if(c) > 1, several).otherwise(F.max(F.when(c, F.col("value")))).alias(n)
            for n, c in layers.items()
        ]
    )


def _pixels(df: DataFrame, value: Column, raster_id, keys: Seq[str] = CELL) -> DataFrame:
    return df.select(
        F.lit(raster_id).alias("raster_id"), F.lit(1).alias("band"), *keys, value.alias("value")
    )


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (|a + b| + 1e-10), 0 where a + b is 0."""
    total = a + b
    return F.when(total == 0, 0.0).otherwise((a - b) / (F.abs(total) + 1e-10))


def ndvi(pixels: DataFrame, nir: Column, red: Column, out_id="ndvi", grids: DataFrame | None = None, to=None) -> DataFrame:
    """Normalised difference; with ``grids`` both bands are put on the grid of raster ``to``."""
    d = align(pixels, {"_a": nir, "_b": red}, grids=grids, to=to).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return _pixels(d, normalised_difference(F.col("_a"), F.col("_b")), out_id)


def ndre(
    pixels: DataFrame, nir: Column, red_edge: Column, out_id="ndre", grids: DataFrame | None = None, to=None
) -> DataFrame:
    return ndvi(pixels, nir, red_edge, out_id, grids, to)


def gli(
    pixels: DataFrame,
    red: Column,
    green: Column,
    blue: Column,
    alpha: Column | None = None,
    out_id="gli",
    grids: DataFrame | None = None,
    to=None,
    resolution: float | None = None,
) -> DataFrame:
    """Green leaf index of the chosen bands; pixels with alpha up to 250 are nodata.

    ``resolution`` first puts the bands on cells of that size over the extent of raster ``to``, nearest values."""
    layers = {"_r": red, "_g": green, "_b": blue}
    if resolution:
        from fieldspark.operators.resample import grid_of, with_cell

        to = with_cell(grid_of(grids, to), resolution)
    if alpha is not None:
        layers["_alpha"] = alpha
    d = align(pixels, layers, grids=grids, to=to).filter(
        F.col("_r").isNotNull() & F.col("_g").isNotNull() & F.col("_b").isNotNull()
    )
    g2, r, b = F.col("_g") * 2.0, F.col("_r"), F.col("_b")
    total = g2 + r + b
    value = F.when(F.abs(total) > 1e-10, (g2 - r - b) / (total + 1e-10)).otherwise(0.0)
    if alpha is not None:
        value = F.when(F.col("_alpha") > 250, value).otherwise(NODATA)
    return _pixels(d, value, out_id)


def detect_alpha(pixels: DataFrame, band: int = 4) -> bool:
    """Whether a table has the given alpha band."""
    return bool(pixels.filter(F.col("band") == band).select("band").head(1))


def canopy_height(
    pixels: DataFrame,
    dsm: Column,
    dtm: Column,
    dsm_nodata=NODATA,
    dtm_nodata=NODATA,
    out_id="chm",
    grids: DataFrame | None = None,
    to=None,
) -> DataFrame:
    """Surface minus terrain, not below 0; nodata where either side has none.

    With ``grids`` the terrain is interpolated bilinearly on the grid of the surface raster ``to``."""
    d = align(pixels, {"_s": dsm, "_t": dtm}, grids=grids, to=to, bilinear=("_t",))
    s, t = F.col("_s"), F.col("_t")
    ok = valid(s, dsm_nodata) & valid(t, dtm_nodata)
    return _pixels(d, F.when(ok, F.greatest(s - t, F.lit(0.0))).otherwise(NODATA), out_id)


def _extent(g: DataFrame) -> DataFrame:
    return g.select(
        F.col("raster_id"),
        F.col("x0").alias("xmin"),
        (F.col("y0") - F.col("nrows") * F.col("dy")).alias("ymin"),
        (F.col("x0") + F.col("ncols") * F.col("dx")).alias("xmax"),
        F.col("y0").alias("ymax"),
        "nodata",
    )


def raster_pairs(grids: DataFrame) -> DataFrame:
    """All pairs of rasters whose extents overlap, the smaller id first."""
    from fieldspark.operators.spatial import box_join

    e = _extent(grids)
    pairs = box_join(e, e, self_join="raster_id")
    return pairs.select(
        F.col("a.raster_id").alias("raster_a"),
        F.col("b.raster_id").alias("raster_b"),
        F.col("a.nodata").alias("nodata_a"),
        F.col("b.nodata").alias("nodata_b"),
    )


def pairwise_difference(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Pixels of A - B for each overlapping pair, on the cells of A.

    B is read at the centres of A's cells.  Nodata of A replaces the difference where either side has none.
    Pixels meet by an equi join on (pair, cell)."""
    pairs = raster_pairs(grids)
    px = pixels.filter(F.col("band") == 1).select("raster_id", *CELL, "value")
    a = join_on(
        px.withColumnRenamed("raster_id", "raster_a"), pairs.select("raster_a", "raster_b", "nodata_a"), ["raster_a"]
    ).withColumnRenamed("value", "_a")
    shape = grids.select("raster_id", "x0", "y0", "dx", "dy", "ncols", "nrows")
    named = lambda side: shape.select(*[F.col(c).alias(f"raster_{side}" if c == "raster_id" else f"_{side}_{c}") for c in shape.columns])
    placed = join_on(join_on(pairs, named("a"), ["raster_a"]), named("b"), ["raster_b"]).drop("nodata_a")
    b = join_on(px.withColumnRenamed("raster_id", "raster_b"), placed, ["raster_b"]).withColumnRenamed("value", "_b")

    def cells(index: str, offset: Column, size: str, count: str) -> Column:
        """Cells of A along one axis whose centres lie in B's cell."""
        own, target = F.col(f"_b_{size}"), F.col(f"_a_{size}")
        low = F.ceil((offset + F.col(index) * own) / target - 0.5).cast("int")
        high = F.ceil((offset + (F.col(index) + 1) * own) / target - 0.5).cast("int") - 1
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col(f"_a_{count}").cast("int") - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = cells("row", F.col("_a_y0") - F.col("_b_y0"), "dy", "nrows")
    cols = cells("col", F.col("_b_x0") - F.col("_a_x0"), "dx", "ncols")
    b = b.select("raster_a", "raster_b", "nodata_b", "_b", F.explode(rows).alias("_row"), cols.alias("_cols"))
    b = b.select("raster_a", "raster_b", "nodata_b", "_b", F.col("_row").alias("row"), F.explode("_cols").alias("col"))
    d = a.join(b, ["raster_a", "raster_b", *CELL])
    ok = (F.col("_a") != F.col("nodata_a")) & (F.col("_b") != F.col("nodata_b"))
    diff = F.when(ok, F.col("_a") - F.col("_b")).otherwise(F.col("nodata_a"))
    return d.select("raster_a", "raster_b", *CELL, diff.alias("value"), ok.alias("valid"))


def raster_differences(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Min, max, interval, mean and deviation of the difference of each raster pair."""
    v = F.when(F.col("valid"), F.col("value"))
    return (
        pairwise_difference(pixels, grids)
        .groupBy("raster_a", "raster_b")
        .agg(
            F.count(v).alias("count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            (F.max(v) - F.min(v)).alias("interval"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std_dev"),
        )
    )


def weighted_average(
    pixels: DataFrame, weights: dict, out_id="weighted", grids: DataFrame | None = None, band: int = 1
) -> DataFrame:
    """Weighted mean of 2 to 4 rasters where all of them have a value.

    With ``grids`` they are put on the grid of the first one."""
    total = float(sum(weights.values()))
    if total == 0:
        raise ValueError("weights sum to 0")
    names = {f"_r{i}": layer(r, band) for i, r in enumerate(weights)}
    d = align(pixels, names, grids=grids, to=next(iter(weights)))
    value, ok = F.lit(0.0), F.lit(True)
    for n, w in zip(names, weights.values()):
        value = value + F.col(n) * float(w)
        ok = ok & F.col(n).isNotNull()
    return _pixels(d.filter(ok), value / total, out_id)


def adjust_mean(pixels: DataFrame, target: float, nodata: float | None = NODATA) -> DataFrame:
    """Scale every raster so its mean is ``target``; nodata stays, a zero mean is an error."""
    ok = valid(F.col("value"), nodata)
    means = pixels.groupBy("raster_id", "band").agg(F.avg(F.when(ok, F.col("value"))).alias("_mean"))
    d = join_on(pixels, means, ["raster_id", "band"])
    factor = F.when(F.col("_mean") != 0, F.lit(float(target)) / F.col("_mean")).otherwise(
        F.raise_error(F.lit("the raster mean is zero")).cast("double")
    )
    return d.withColumn("value", F.when(ok, F.col("value") * factor).otherwise(F.col("value"))).select(
        *PIXEL
    )


def to_reflectance(
    pixels: DataFrame,
    nodata: float | None = None,
    scale: float = 10000.0,
    band_name: str | None = None,
    integer: bool = True,
) -> DataFrame:
    """Integer counts to reflectance; nodata, class bands and float rasters stay."""
    if not integer or (band_name or "").upper() == "SCL":
        return pixels
    v = F.col("value")
    scaled = v / scale
    if nodata is not None:
        scaled = F.when(v == nodata, v).otherwise(scaled)
    return pixels.withColumn("value", scaled)


def extract_band(pixels: DataFrame, band: int) -> DataFrame:
    return pixels.filter(F.col("band") == band).withColumn("band", F.lit(1))


def stack_bands(bands: Seq[DataFrame], out_id="stack", grids: DataFrame | None = None) -> DataFrame:
    """Single-band pixel tables as bands 1..n of one raster.

    Without ``grids`` they share one grid.  With them bands of any resolution are put on `finest_grid` of their
    rasters, nearest values; ``grids`` then holds those rasters and no others."""
    out, target = None, None
    if grids is not None:
        from fieldspark.operators.resample import finest_grid, resample

        target = finest_grid(grids)
    for i, b in enumerate(bands, 1):
        b = resample(b.withColumn("band", F.lit(1)).select(*PIXEL), grids, target) if target else b
        part = b.select(
            F.lit(out_id).alias("raster_id"), F.lit(i).alias("band"), *CELL, F.col("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


def alpha_mask(pixels: DataFrame, nodata: float, tolerance: float = 1e-6) -> DataFrame:
    """0 on nodata, 255 elsewhere."""
    empty = F.abs(F.col("value") - nodata) <= tolerance
    return pixels.withColumn("value", F.when(empty, 0.0).otherwise(255.0))


def stretch_limits(
    pixels: DataFrame, low: float = 0.02, high: float = 0.98, nodata: float | None = None, sketch: int | None = None
) -> DataFrame:
    """Display limits per band: the lowest low and the highest high percentile of all rasters.

    ``sketch`` takes them from sketches of that size, in one pass and bounded memory."""
    px = pixels.filter(valid(F.col("value"), nodata))
    keys, wanted = ["raster_id", "band"], {"low": low, "high": high}
    per = quantiles_of(sketches(px, keys, "value", sketch), keys, wanted) if sketch else order_statistics(px, keys, "value", wanted)
    return per.groupBy("band").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def overviews(
    pixels: DataFrame, levels: Seq[int] = (2, 4, 8, 16), method: str = "average", nodata: float | None = None
) -> DataFrame:
    """Pyramid levels as one table with a ``level`` column.

    Average, min, max and nearest levels are built from the level before (average
    by carried sums, so every level is exact); mode is taken from the base.
    """
    keys = ["raster_id", "band"]
    base = pixels.filter(valid(F.col("value"), nodata))

    def cell(df: DataFrame, k: int) -> DataFrame:
        return df.withColumns(
            {"row": F.floor(F.col("row") / k).cast("int"), "col": F.floor(F.col("col") / k).cast("int")}
        )

    out, previous, at = None, None, 1
    for level in sorted(levels):
        if method == "mode":
            counts = cell(base, level).groupBy(*keys, *CELL, "value").agg(F.count(F.lit(1)).alias("_n"))
            lvl = counts.groupBy(*keys, *CELL).agg(
                F.max_by("value", F.struct("_n", -F.col("value"))).alias("value")
            )
        else:
            chained = previous is not None and level % at == 0
            step, source = (level // at, previous) if chained else (level, None)
            if source is None:
                source = base.withColumns(
                    {"_s": F.col("value"), "_c": F.lit(1), "_o": F.struct("row", "col")}
                )
            grouped = cell(source, step).groupBy(*keys, *CELL)
            value = {
                "average": F.sum("_s") / F.sum("_c"),
                "min": F.min("value"),
                "max": F.max("value"),
                "nearest": F.min_by("value", "_o"),
            }[method]
            previous = grouped.agg(
                value.alias("value"), F.sum("_s").alias("_s"), F.sum("_c").alias("_c"), F.min("_o").alias("_o")
            )
            at = level
            lvl = previous.drop("_s", "_c", "_o")
        lvl = lvl.withColumn("level", F.lit(level))
        out = lvl if out is None else out.unionByName(lvl)
    return out.select("level", *PIXEL)


def summary(pixels: DataFrame, nodata: float | None = NODATA) -> DataFrame:
    """Per raster and band: count, nodata share, min, max, mean, median and deviation."""
    ok = valid(F.col("value"), nodata)
    v = F.when(ok, F.col("value"))
    keys = ["raster_id", "band"]
    base = pixels.groupBy(*keys).agg(
        F.count(v).alias("count"),
        ((F.count(F.lit(1)) - F.count(v)) * 100.0 / F.count(F.lit(1))).alias("nodata_pct"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("variance"),
    )
    median = order_statistics(pixels.filter(ok), keys, "value", {"median": 0.5})
    return join_on(base, median, keys, "left")


def histogram(pixels: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Pixel count per equal-width bin; the last bin includes the upper limit."""
    width = (high - low) / bins
    v = F.col("value")
    idx = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    return (
        pixels.filter(v.between(low, high))
        .groupBy("raster_id", "band", idx.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("from", F.lit(low) + F.col("bin") * width)
    )


def class_areas(pixels: DataFrame, pixel_area: float) -> DataFrame:
    """Count, share and area of every distinct value per raster and band."""
    keys = ["raster_id", "band"]
    counts = pixels.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))
    totals = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    return join_on(counts, totals, keys).select(
        *keys,
        "value",
        "count",
        (F.col("count") * 100.0 / F.col("_t")).alias("pct"),
        (F.col("count") * pixel_area).alias("area"),
    )


def correlation(pixels: DataFrame, a: Column, b: Column) -> DataFrame:
    d = align(pixels, {"_a": a, "_b": b}).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return d.agg(F.count(F.lit(1)).alias("count"), F.corr("_a", "_b").alias("correlation"))


def reclassify(pixels: DataFrame, ranges: Seq[tuple[float, float, float]], default: float | None = None):
    """Values in [low, high) become the class value."""
    v = F.col("value")
    out = F.lit(default).cast("double") if default is not None else v
    for low, high, cls in reversed(list(ranges)):
        out = F.when((v >= low) & (v < high), float(cls)).otherwise(out)
    return pixels.withColumn("value", out)


def threshold(pixels: DataFrame, cut: float) -> DataFrame:
    return pixels.withColumn("value", F.when(F.col("value") >= cut, 1.0).otherwise(0.0))


def _per_raster_range(pixels: DataFrame, nodata: float | None) -> DataFrame:
    ok = valid(F.col("value"), nodata)
    v = F.when(ok, F.col("value"))
    limits = pixels.groupBy("raster_id", "band").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return join_on(pixels, limits, ["raster_id", "band"]).withColumn("_ok", ok)


def normalise(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Values scaled to 0..1 per raster and band."""
    d = _per_raster_range(pixels, nodata)
    span = F.col("_hi") - F.col("_lo")
    v = F.when(span == 0, 0.0).otherwise((F.col("value") - F.col("_lo")) / span)
    return d.withColumn("value", F.when(F.col("_ok"), v).otherwise(F.col("value"))).select(*PIXEL)


def invert(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Values mirrored between the lowest and the highest of each raster and band."""
    d = _per_raster_range(pixels, nodata)
    v = F.col("_hi") + F.col("_lo") - F.col("value")
    return d.withColumn("value", F.when(F.col("_ok"), v).otherwise(F.col("value"))).select(*PIXEL)


def to_points(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Pixel centres with their values."""
    d = join_on(pixels, grids, ["raster_id"])
    return d.select(
        *PIXEL,
        (F.col("x0") + (F.col("col") + 0.5) * F.col("dx")).alias("x"),
        (F.col("y0") - (F.col("row") + 0.5) * F.col("dy")).alias("y"),
    )


def to_tiles(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Pixel rows packed into square tiles; a missing pixel is null in the array."""
    r, c = F.col("row"), F.col("col")
    at = (r % size) * size + c % size
    packed = pixels.groupBy(
        "raster_id",
        "band",
        F.floor(r / size).cast("int").alias("tile_row"),
        F.floor(c / size).cast("int").alias("tile_col"),
    ).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("value")))).alias("_m"))
    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    return packed.select(
        "raster_id",
        "band",
        "tile_row",
        "tile_col",
        F.transform(cells, lambda i: F.try_element_at("_m", i)).alias("values"),
    )


def from_tiles(tiles: DataFrame, size: int = 256) -> DataFrame:
    d = tiles.select(
        "raster_id", "band", "tile_row", "tile_col", F.posexplode("values").alias("_i", "value")
    )
    return d.filter(F.col("value").isNotNull()).select(
        "raster_id",
        "band",
        (F.col("tile_row") * size + F.floor(F.col("_i") / size)).cast("int").alias("row"),
        (F.col("tile_col") * size + F.col("_i") % size).cast("int").alias("col"),
        "value",
    )


def tile_index(tiles: DataFrame, a: Column, b: Column, out_id="index") -> DataFrame:
    """Normalised difference of two layers kept as tiles: one row per tile is shuffled, not per pixel."""
    keys = ["tile_row", "tile_col"]
    d = (
        tiles.filter(a | b)
        .groupBy(*keys)
        .agg(F.first(F.when(a, F.col("values")), True).alias("_a"), F.first(F.when(b, F.col("values")), True).alias("_b"))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    return d.select(
        F.lit(out_id).alias("raster_id"),
        F.lit(1).alias("band"),
        *keys,
        F.zip_with("_a", "_b", normalised_difference).alias("values"),
    )
