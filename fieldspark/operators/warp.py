"""Rasters in another coordinate system.

Centres of target cells are traced back to the source.  A projection is dear and smooth, so it is worked out exactly at
the corners of a mesh over the target grid and bilinearly between them.  A block of the mesh whose middle and edge
middles are further off than the tolerance is cut into as many parts as the error, which falls with the square of the
side, asks for; parts that still miss it are traced cell by cell.  Positions then meet pixels by an equi join on the
cell, once for nearest values and once for each tap of a kernel; statistics of cells go the other way, each source
pixel's centre traced forward to one target cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.crs import transform_point
from fieldspark.functions.geo import bind
from fieldspark.operators.resample import _KEYS, _REACH, METHODS, Grid, _kernel, _with_grid, cell_statistics

#: Cells of a mesh block's side, a power of two, and halvings until a part is one cell.
MESH, _HALVINGS = 64, 6
#: Points of each edge of a raster that are traced to find its extent.
EDGE_POINTS = 21
_SHAPE = ("x0", "y0", "dx", "dy", "ncols", "nrows")


def _srids(grids: DataFrame) -> list[int]:
    found = sorted(r[0] for r in grids.select("srid").distinct().limit(1000).collect() if r[0] is not None)
    if grids.filter("srid is null").head(1):
        raise ValueError("a raster has no coordinate system")
    return found


def warp_grids(grids: DataFrame, srid: int, cell: float | None = None) -> DataFrame:
    """Grids of the same rasters in another system, with square cells.

    Without ``cell`` the diagonal keeps its number of cells.  Rasters of which some edge point has no place in the
    system are left out."""
    step = F.sequence(F.lit(0), F.lit(EDGE_POINTS - 1))
    share = lambda i: i.cast("double") / (EDGE_POINTS - 1)
    ends = (F.lit(0.0), F.lit(1.0))
    edge = F.concat(
        *[F.transform(step, lambda i, e=e: F.struct(share(i).alias("u"), e.alias("v"))) for e in ends],
        *[F.transform(step, lambda i, e=e: F.struct(e.alias("u"), share(i).alias("v"))) for e in ends],
    )
    out = None
    for s in _srids(grids):
        moved = F.transform(
            edge,
            lambda p: transform_point(  # noqa: B023
                F.col("x0") + p["u"] * F.col("ncols") * F.col("dx"), F.col("y0") - p["v"] * F.col("nrows") * F.col("dy"), s, srid  # noqa: B023
            ),
        )
        d = grids.filter(F.col("srid") == s).withColumn("_p", _once(moved))
        out = d if out is None else out.unionByName(d)
    xs, ys = F.transform("_p", lambda p: p["x"]), F.transform("_p", lambda p: p["y"])
    fine = F.forall("_p", lambda p: p["x"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) + F.abs(p["y"]) < float("inf")))
    width, height = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    size = F.lit(cell) if cell else F.hypot(width, height) / F.hypot(F.col("ncols").cast("double"), F.col("nrows").cast("double"))
    d = out.filter(fine).withColumns({"_w": width, "_h": height, "_s": size, "_x": F.array_min(xs), "_y": F.array_max(ys)})
    # A width of whole cells is not rounded up for the last bit of a double.
    count = lambda c: F.greatest(F.ceil(F.col(c) / F.col("_s") - 1e-9), F.lit(1).cast("long")).cast("int")
    return d.select(
        "raster_id", F.col("_x").alias("x0"), F.col("_y").alias("y0"), F.col("_s").alias("dx"), F.col("_s").alias("dy"),
        count("_w").alias("ncols"), count("_h").alias("nrows"), F.lit(srid).alias("srid"), "nodata",
    )


def as_grids(grids: DataFrame, target: Grid) -> DataFrame:
    """The same target grid for every raster."""
    return grids.select("raster_id", *[F.lit(getattr(target, n)).alias(n) for n in _SHAPE])


def _traced(points: Column, srid: int, source: int) -> Column:
    """Places (u, v) in cells of the target as places in cells of the source."""

    def one(p: Column) -> Column:
        x, y = F.col("_tx0") + p["u"] * F.col("_tdx"), F.col("_ty0") - p["v"] * F.col("_tdy")
        return bind(
            transform_point(x, y, srid, source),
            lambda q: F.struct(
                ((q.x - F.col("x0")) / F.col("dx")).alias("u"), ((F.col("y0") - q.y) / F.col("dy")).alias("v")
            ),
        )

    return F.transform(points, one)


def _once(value: Column) -> Column:
    """A column that Spark works out once for a row: it neither copies nor moves filters into what explode makes."""
    return F.explode(F.array(value))


def _at(u: Column, v: Column) -> Column:
    return F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))


def _between(corners: Column, s: Column, t: Column) -> Column:
    """The bilinear place at shares s and t of a block; corners run along its first edge, then its last."""
    a, b, c, d = (F.get(corners, F.lit(i)) for i in range(4))
    mix = lambda n: (1 - t) * ((1 - s) * a[n] + s * b[n]) + t * ((1 - s) * c[n] + s * d[n])
    return F.struct(mix("u").alias("u"), mix("v").alias("v"))


_SHARES = ((0.5, 0.5), (0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.5))


def _meshed(d: DataFrame, srid: int, source: int) -> DataFrame:
    """Corners of each part (_r, _c, _size) traced exactly, and how far the bilinear place is off in source cells."""
    u0, v0, n = F.col("_c"), F.col("_r"), F.col("_size")
    corners = F.array(_at(u0, v0), _at(u0 + n, v0), _at(u0, v0 + n), _at(u0 + n, v0 + n))
    checks = F.array(*[_at(u0 + s * n, v0 + t * n) for s, t in _SHARES])
    d = d.withColumn("_all", _once(_traced(F.concat(corners, checks), srid, source)))
    d = d.withColumns({"_corners": F.slice("_all", 1, 4), "_exact": F.slice("_all", 5, len(_SHARES))}).drop("_all")
    off = [
        F.greatest(F.abs(p["u"] - q["u"]), F.abs(p["v"] - q["v"]))
        for p, q in ((_between(F.col("_corners"), F.lit(s), F.lit(t)), F.get("_exact", F.lit(i))) for i, (s, t) in enumerate(_SHARES))
    ]
    worst = F.array_max(F.array(*off))
    # No place at all counts as far off.
    d = d.withColumn("_off", _once(worst)).drop("_exact")
    return d.withColumn("_off", F.when(F.isnan("_off"), float("inf")).otherwise(F.coalesce("_off", F.lit(float("inf")))))


def _spread(d: DataFrame, step: Column, rows: Column, cols: Column) -> DataFrame:
    """Parts of side `step` of blocks that begin at _r and _c; only those that begin inside the grid."""
    starts = lambda first, size, most: F.filter(F.sequence(first, first + size - 1, step), lambda i: i < most)
    d = d.withColumns({"_rows": starts(F.col("_r"), F.col("_size"), rows), "_cols": starts(F.col("_c"), F.col("_size"), cols)})
    d = d.withColumn("_r", F.explode("_rows")).withColumn("_c", F.explode("_cols"))
    return d.drop("_rows", "_cols")


def positions(grids: DataFrame, target: DataFrame, srid: int, tolerance: float = 0.125) -> DataFrame:
    """raster_id, row, col of every target cell whose centre lies in its raster, with its place u, v in source cells.

    Places are off by ``tolerance`` source cells at most where the projection is smooth; 0 traces every cell."""
    named = target.select("raster_id", *[F.col(n).alias(f"_t{n}") for n in _SHAPE])
    out = None
    for s in _srids(grids):
        own = grids.filter(F.col("srid") == s).select("raster_id", *_SHAPE).join(named, "raster_id")
        first = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1, F.lit(MESH))
        blocks = own.withColumn("_size", F.lit(MESH)).withColumn("_r", F.explode(first("_tnrows"))).withColumn("_c", F.explode(first("_tncols")))
        d = _meshed(blocks, srid, s)
        # The error is largest between the points it is measured at, hence half the tolerance.
        limit = tolerance / 2
        cuts = F.ceil(F.log(4.0, F.col("_off") / limit)) if tolerance else F.lit(_HALVINGS)
        halvings = F.when(F.col("_off") <= limit, 0).when(F.col("_off") == float("inf"), _HALVINGS).otherwise(F.least(cuts, F.lit(_HALVINGS)))
        d = d.withColumn("_part", _once(F.call_function("shiftright", F.lit(MESH), F.greatest(halvings, F.lit(0)).cast("int"))))
        d = _spread(d.drop("_corners", "_off"), F.col("_part"), F.col("_tnrows"), F.col("_tncols"))
        d = _meshed(d.withColumn("_size", F.col("_part")), srid, s)
        d = d.withColumns({"_r0": F.col("_r"), "_c0": F.col("_c")})
        cells = _spread(d, F.lit(1), F.col("_tnrows"), F.col("_tncols"))
        centre_u, centre_v = F.col("_c") + 0.5, F.col("_r") + 0.5
        guess = _between(F.col("_corners"), (centre_u - F.col("_c0")) / F.col("_size"), (centre_v - F.col("_r0")) / F.col("_size"))
        exact = F.get(_traced(F.array(_at(centre_u, centre_v)), srid, s), F.lit(0))
        cells = cells.withColumn("_at", _once(F.when(F.col("_off") <= limit, guess).otherwise(exact) if tolerance else exact))
        cells = cells.filter("_at.u >= 0 and _at.v >= 0 and _at.u < ncols and _at.v < nrows")
        cells = cells.select("raster_id", F.col("_r").alias("row"), F.col("_c").alias("col"), "_at.u", "_at.v")
        out = cells if out is None else out.unionByName(cells)
    return out


def _forward(pixels: DataFrame, grids: DataFrame, target: DataFrame, srid: int) -> DataFrame:
    """Source pixels with the target cell that holds their centre."""
    named = target.select("raster_id", *[F.col(n).alias(f"_t{n}") for n in _SHAPE])
    d = _with_grid(pixels, grids).join(grids.select("raster_id", F.col("srid").alias("_srid")), "raster_id").join(named, "raster_id")
    x, y = F.col("_x0") + (F.col("col") + 0.5) * F.col("_dx"), F.col("_y0") - (F.col("row") + 0.5) * F.col("_dy")
    place = F.lit(None).cast("struct<x:double,y:double>")
    for s in _srids(grids):
        place = F.when(F.col("_srid") == s, transform_point(x, y, s, srid)).otherwise(place)
    d = d.withColumn("_p", _once(place))
    row, col = F.floor((F.col("_ty0") - F.col("_p.y")) / F.col("_tdy")), F.floor((F.col("_p.x") - F.col("_tx0")) / F.col("_tdx"))
    d = d.select("raster_id", "band", row.cast("int").alias("row"), col.cast("int").alias("col"), "value", "_tnrows", "_tncols")
    return d.filter("row >= 0 and col >= 0 and row < _tnrows and col < _tncols").select(*_KEYS, "value")


def reproject_raster(
    pixels: DataFrame, grids: DataFrame, target: DataFrame | Grid, srid: int, method: str = "nearest", tolerance: float = 0.125
) -> DataFrame:
    """Pixels of every raster on a grid of another system; nodata pixels do not contribute.

    ``target`` is one grid for all rasters or a table of grids by raster_id, as `warp_grids` makes it.  Kernels have
    their plain width: reduce a raster with `resample` first where target cells are much larger than its own."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    target = as_grids(grids, target) if isinstance(target, Grid) else target
    if method not in _REACH and method != "nearest":
        return cell_statistics(_forward(pixels, grids, target, srid), method)
    at = positions(grids, target, srid, tolerance)
    source = _with_grid(pixels, grids).select("raster_id", "band", F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value")
    if method == "nearest":
        cells = at.withColumns({"_sr": F.floor("v").cast("int"), "_sc": F.floor("u").cast("int")})
        return cells.join(source, ["raster_id", "_sr", "_sc"]).select(*_KEYS, "value")
    reach = int(_REACH[method])
    first = lambda c: F.floor(F.col(c) - 0.5).cast("int")
    taps = lambda c: F.sequence(first(c) - reach + 1, first(c) + reach)
    tapped = at.withColumn("_sr", F.explode(taps("v"))).withColumn("_sc", F.explode(taps("u")))
    weight = _kernel(method, F.col("v") - 0.5 - F.col("_sr")) * _kernel(method, F.col("u") - 0.5 - F.col("_sc"))
    weighed = tapped.withColumn("_w", weight).filter("_w != 0").join(source, ["raster_id", "_sr", "_sc"])
    total = F.sum("_w")
    return weighed.groupBy(*_KEYS).agg(F.when(total != 0, F.sum(F.col("_w") * F.col("value")) / total).alias("value")).filter("value is not null")
