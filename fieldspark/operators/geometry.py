"""Geometry operators on point, line and polygon columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.crs import is_geographic
from fieldspark.operators.spatial import intersects

# Fixed value: latitude and longitude shown when no photo has a position.
DEFAULT_CENTER = (-10.217, -48.359)


def explode_multipart(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per part, attributes repeated; the part number is kept."""
    others = [c for c in df.columns if c != geom]
    return df.select(*others, F.posexplode_outer(geom).alias("part", geom))


def explode_lines(df: DataFrame, geom: str = "geom", multi: bool = False) -> DataFrame:
    """Lines cut into two-vertex segments; parts with fewer vertices give none."""
    others = [c for c in df.columns if c != geom]
    parts = F.col(geom) if multi else F.array(geom)

    def cut(line: Column) -> Column:
        n = F.size(line)
        idx = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.array(F.element_at(line, i - 1), F.element_at(line, i)))

    segments = F.flatten(F.transform(parts, cut))
    return df.select(*others, F.posexplode(segments).alias("segment", geom))


def _arc(centre: Column, radius: Column, start: Column, sweep: float, steps: int) -> Column:
    """Points on an arc from ``start`` (radians) over ``sweep`` in equal steps."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda k: geo.point(
            centre.x + radius * F.cos(start + k * (sweep / steps)),
            centre.y + radius * F.sin(start + k * (sweep / steps)),
        ),
    )


def buffer_point(p: Column, distance: Column, segments: int = 5) -> Column:
    """Polygon around a point with ``segments`` steps per quarter circle."""
    ring = _arc(p, distance, F.lit(math.pi / 2), -2 * math.pi, 4 * segments)
    return F.array(F.slice(ring, 1, 4 * segments))


def _capsule(p: Column, q: Column, heading: Column, distance: Column, segments: int) -> Column:
    """Ring around p and q, whose direction is ``heading``; vertices are written out, which Spark compiles."""

    def arc(centre: Column, start: Column) -> list[Column]:
        turns = [F.lit(k * (-math.pi / (2 * segments))) for k in range(2 * segments + 1)]
        return [geo.point(centre.x + distance * F.cos(start + t), centre.y + distance * F.sin(start + t)) for t in turns]

    half = math.pi / 2
    return F.array(*arc(q, heading + half), *arc(p, heading - half))


def buffer(
    df: DataFrame, distance: float, kind: str = "point", segments: int = 5, geom: str = "geom"
) -> DataFrame:
    """Buffer points or two-vertex segments; cut longer lines with ``explode_lines`` first."""
    by = F.lit(float(distance))
    if kind == "point":
        return df.withColumn(geom, buffer_point(F.col(geom), by, segments))
    # Capsules with round caps; columns of their own are worked out once a row.
    d = df.withColumns({"_p": F.element_at(geom, 1), "_q": F.element_at(geom, 2)})
    p, q = F.col("_p"), F.col("_q")
    d = d.withColumn("_heading", F.atan2(q.y - p.y, q.x - p.x))
    ring = F.array(_capsule(p, q, F.col("_heading"), by, segments))
    same = (p.x == q.x) & (p.y == q.y)
    return d.withColumn(geom, F.when(same, buffer_point(p, by, segments)).otherwise(ring)).select(*df.columns)


def implement_trail(
    lines: DataFrame, width: float, srid: int, geom: str = "geom", multi: bool = False, segments: int = 5
) -> DataFrame:
    """Area an implement of ``width`` metres covers along lines: one capsule per segment."""
    per_degree = geo.METRES_PER_DEGREE if is_geographic(srid) else 1.0
    cut = explode_lines(lines, geom, multi)
    return buffer(cut, width / 2.0 / per_degree, "segment", segments, geom)


def _shift_line(line: Column, d: Column) -> Column:
    """Line moved sideways by ``d`` (left is positive), mitred at inner vertices."""
    n = F.size(line)

    def normal(i: Column) -> Column:
        """Left unit normal of the segment that ends at vertex i."""
        p, q = F.element_at(line, i - 1), F.element_at(line, i)
        length = F.hypot(q.x - p.x, q.y - p.y)
        return F.struct((-(q.y - p.y) / length).alias("x"), ((q.x - p.x) / length).alias("y"))

    def vertex(i: Column) -> Column:
        before = normal(F.greatest(i, F.lit(2)))
        after = normal(F.least(i + 1, n))
        return geo.bind(
            F.struct(before.alias("u"), after.alias("v")),
            lambda s: geo.bind(
                1.0 + s.u.x * s.v.x + s.u.y * s.v.y,
                lambda k: geo.point(
                    F.element_at(line, i).x
                    + d * F.when(k > 1e-9, (s.u.x + s.v.x) / k).otherwise(s.u.x),
                    F.element_at(line, i).y
                    + d * F.when(k > 1e-9, (s.u.y + s.v.y) / k).otherwise(s.u.y),
                ),
            ),
        )

    return F.transform(F.sequence(F.lit(1), n), vertex)


def offset_lines(df: DataFrame, spacing: float, count: int, geom: str = "geom") -> DataFrame:
    """``count`` parallel lines on each side, ``spacing`` apart, duplicates removed."""
    steps = [k * spacing for k in range(1, count + 1)]
    shifts = F.array(*[F.lit(float(s)) for k in steps for s in (k, -k)])
    others = [c for c in df.columns if c != geom]
    d = df.withColumn("offset", F.explode(shifts)).filter(F.size(geom) >= 2)
    d = d.select(*others, "offset", _shift_line(F.col(geom), F.col("offset")).alias(geom))
    return d.dropDuplicates([geom])


def regular_grid(
    df: DataFrame, dx: float, dy: float, kind: str = "rectangle", geom: str = "geom", feature_kind: str = "polygon"
) -> DataFrame:
    """Cells of a regular grid over the layer extent that intersect a feature.

    Every feature lists the cells its box touches, so the work grows with the
    features and not with the empty part of the extent.  Ids run down the columns
    from the left, as numbers in the whole grid: rectangles and points by (col, row);
    of lines the horizontal ones (col is null) come first, then the vertical ones.
    """
    from fieldspark.operators.spatial import with_box

    d = with_box(df, geom, feature_kind)
    e = d.agg(
        F.min("xmin").alias("x0"), F.max("ymax").alias("y0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y1")
    )
    d = d.crossJoin(F.broadcast(e))  # one row
    ncols = F.ceil((F.col("x1") - F.col("x0")) / dx)
    nrows = F.ceil((F.col("y0") - F.col("y1")) / dy)

    def span(lo: Column, hi: Column, n: Column, points: bool) -> Column:
        # A feature on a cell edge touches the cells on both sides.
        a = F.greatest(F.ceil(lo) if points else F.ceil(lo) - 1, F.lit(0).cast("bigint"))
        b = F.least(F.floor(hi), n.cast("bigint") - (0 if points else 1))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    c0, c1 = (F.col("xmin") - F.col("x0")) / dx, (F.col("xmax") - F.col("x0")) / dx
    r0, r1 = (F.col("y0") - F.col("ymax")) / dy, (F.col("y0") - F.col("ymin")) / dy
    left, top = F.col("x0") + F.col("col") * dx, F.col("y0") - F.col("row") * dy
    if kind == "line":
        none = F.array(F.lit(None).cast("bigint"))
        across = d.withColumn("row", F.explode(span(r0, r1, nrows, True))).withColumn("col", F.explode(none))
        along = d.withColumn("col", F.explode(span(c0, c1, ncols, True))).withColumn("row", F.explode(none))
        flat = F.array(geo.point(F.col("x0"), top), geo.point(F.col("x0") + ncols * dx, top))
        tall = F.array(geo.point(left, F.col("y0")), geo.point(left, F.col("y0") - nrows * dy))
        across = across.withColumns({"_g": flat, "_id": F.col("row") + 1})
        along = along.withColumns({"_g": tall, "_id": nrows + 1 + F.col("col") + 1})
        hits = across.unionByName(along).filter(intersects(F.col("_g"), "line", F.col(geom), feature_kind))
        # All lines of an id are equal.
        found = hits.groupBy(F.col("_id").alias("id"), "row", "col").agg(F.first("_g").alias("geom"))
        return found.select("id", "row", "col", "geom")
    points = kind == "point"
    d = d.withColumn("row", F.explode(span(r0, r1, nrows, points)))
    d = d.withColumn("col", F.explode(span(c0, c1, ncols, points)))
    if points:
        d = d.withColumns({"_g": geo.point(left, top), "_id": F.col("col") * (nrows + 1) + F.col("row") + 1})
        hits = d.filter(intersects(F.col("_g"), "point", F.col(geom), feature_kind))
        found = hits.groupBy(F.col("_id").alias("id"), "row", "col").agg(F.first("_g").alias("geom"))
        return found.select("id", "row", "col", "geom")
    right, bottom = left + dx, top - dy
    ring = F.array(
        geo.point(left, top), geo.point(right, top), geo.point(right, bottom), geo.point(left, bottom)
    )
    d = d.withColumns({"_g": F.array(ring), "_nr": nrows})
    if feature_kind == "point":
        g = F.col(geom)
        touching = g.x.between(left, right) & g.y.between(bottom, top)
    else:
        touching = intersects(F.col("_g"), "polygon", F.col(geom), feature_kind)
    out = d.filter(touching).groupBy("row", "col").agg(
        F.first("_g").alias("geom"), F.first("_nr").alias("_nr")
    )
    return out.select((F.col("col") * F.col("_nr") + F.col("row") + 1).alias("id"), "row", "col", "geom")


def rep_point(geom: Column, kind: str) -> Column:
    """First vertex of a point set, area centroid of a polygon."""
    if kind == "point":
        return geom
    if kind == "multipoint":
        return F.try_element_at(geom, F.lit(1))
    if kind == "line":
        return line_centroid(geom)
    return geo.ring_centroid(F.element_at(geom, 1))


def line_centroid(line: Column) -> Column:
    """Length-weighted mean of the segment midpoints."""
    n = F.size(line)
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        p, q = F.element_at(line, i - 1), F.element_at(line, i)
        return geo.bind(
            F.hypot(q.x - p.x, q.y - p.y),
            lambda k: F.struct(
                (acc.l + k).alias("l"),
                (acc.x + k * (p.x + q.x) / 2.0).alias("x"),
                (acc.y + k * (p.y + q.y) / 2.0).alias("y"),
            ),
        )

    idx = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    first = F.try_element_at(line, F.lit(1))
    return geo.bind(
        F.aggregate(idx, zero, add),
        lambda s: F.when(s.l > 0, geo.point(s.x / s.l, s.y / s.l)).otherwise(first),
    )


def photo_footprints(df: DataFrame, keep: float = 0.7) -> DataFrame:
    """Ground outline of each photo on flat terrain.

    The four corner rays of a 36 x 24 mm frame, shrunk by ``keep``, are turned by
    yaw, pitch and roll and cut with the ground ``RelativeAltitude`` below the
    camera.  The outline is null when a ray misses the ground.
    """
    cols = set(df.columns)

    def num(*names: str) -> Column:
        found = [F.col(n).cast("string").try_cast("double") for n in names if n in cols]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    lens = F.lit(None).cast("double")
    if "LensSpecification" in cols:
        lens = F.get("LensSpecification", F.lit(0)).cast("string").try_cast("double")
    focal = F.coalesce(lens, num("FocalLength") * 1.95)
    d = df.withColumns(
        {
            "_h": num("RelativeAltitude"),
            "_f": focal,
            "_lat": num("Lat", "GpsLatitude"),
            "_lon": num("Lon", "GpsLongitude"),
            "_y": F.radians(num("GimbalYawDegree")),
            "_p": F.radians(num("GimbalPitchDegree")),
            "_r": F.radians(num("GimbalRollDegree")),
        }
    )
    cy, sy, cp, sp = F.cos("_y"), F.sin("_y"), F.cos("_p"), F.sin("_p")
    cr, sr = F.cos("_r"), F.sin("_r")

    def corner(sign_w: int, sign_h: int) -> Column:
        right = sign_w * 18.0 * keep / F.col("_f")
        down = sign_h * 12.0 * keep / F.col("_f")
        # Body axes forward, right, down turned by roll, then pitch, then yaw.
        ry = right * cr - down * sr
        rz = right * sr + down * cr
        px = cp + rz * sp
        pz = -sp + rz * cp
        north, east = px * cy - ry * sy, px * sy + ry * cy
        t = F.col("_h") / pz
        hit = F.when(pz > 1e-6, t)
        dlat = hit * north / geo.METRES_PER_DEGREE
        dlon = hit * east / (geo.METRES_PER_DEGREE * F.cos(F.radians("_lat")))
        return geo.point(F.col("_lon") + dlon, F.col("_lat") + dlat)

    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    usable = (F.col("_h") > 0) & (F.col("_f") > 0) & ~F.exists(ring, lambda q: q.x.isNull())
    return d.withColumns(
        {
            "footprint": F.when(usable, ring),
            "is_nadir": F.abs(num("GimbalPitchDegree") + 90.0) <= 3.0,
            "focal35_mm": F.col("_f"),
            "keep_fraction": F.lit(keep),
        }
    ).drop("_h", "_f", "_lat", "_lon", "_y", "_p", "_r")


def map_center(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Mean position of the points that are not at (0, 0); a fixed place without any."""
    here = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    origin = (F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)
    return df.filter(here & ~origin).agg(
        F.coalesce(F.avg(lat), F.lit(DEFAULT_CENTER[0])).alias("lat"),
        F.coalesce(F.avg(lon), F.lit(DEFAULT_CENTER[1])).alias("lon"),
    )


def layer_extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(
        F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")
    )
