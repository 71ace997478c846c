"""Distances, lengths, areas and geometry values as Spark columns.

A point is ``struct<x, y>``, a line an array of points, a multi-part geometry or
polygon an array of those.  Geographic points carry longitude in x, latitude in y.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
_B = WGS84_A * (1.0 - WGS84_F)
_E2 = WGS84_F * (2.0 - WGS84_F)
_E = math.sqrt(_E2)
METRES_PER_DEGREE = 111320.0
_VINCENTY_STEPS = 12


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2.0 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """WGS84 ellipsoid distance by Vincenty's inverse series, fixed step count.

    Pairs the series cannot solve (nearly antipodal) get the haversine distance.
    """
    f = WGS84_F
    u1 = F.atan((1.0 - f) * F.tan(F.radians(lat1)))
    u2 = F.atan((1.0 - f) * F.tan(F.radians(lat2)))
    base = F.struct(
        F.sin(u1).alias("s1"),
        F.cos(u1).alias("c1"),
        F.sin(u2).alias("s2"),
        F.cos(u2).alias("c2"),
        F.radians(lon2 - lon1).alias("dl"),
    )

    def angles(k: Column, lam: Column, body: Callable[[Column], Column]) -> Column:
        sl, cl = F.sin(lam), F.cos(lam)
        sin_sigma = F.hypot(k.c2 * sl, k.c1 * k.s2 - k.s1 * k.c2 * cl)
        cos_sigma = k.s1 * k.s2 + k.c1 * k.c2 * cl
        first = F.struct(sin_sigma.alias("ss"), cos_sigma.alias("cs"), sl.alias("sl"))

        def second(v: Column) -> Column:
            sin_alpha = F.when(v.ss == 0, 0.0).otherwise(k.c1 * k.c2 * v.sl / v.ss)
            cos2_alpha = 1.0 - sin_alpha * sin_alpha
            cos_mid = F.when(cos2_alpha <= 1e-15, 0.0).otherwise(
                v.cs - 2.0 * k.s1 * k.s2 / cos2_alpha
            )
            out = F.struct(
                v.ss.alias("ss"),
                v.cs.alias("cs"),
                F.atan2(v.ss, v.cs).alias("sigma"),
                sin_alpha.alias("sa"),
                cos2_alpha.alias("c2a"),
                cos_mid.alias("cm"),
            )
            return bind(out, body)

        return bind(first, second)

    def step(k: Column, lam: Column) -> Column:
        def next_lambda(v: Column) -> Column:
            c = f / 16.0 * v.c2a * (4.0 + f * (4.0 - 3.0 * v.c2a))
            inner = v.cm + c * v.cs * (2.0 * v.cm * v.cm - 1.0)
            return k.dl + (1.0 - c) * f * v.sa * (v.sigma + c * v.ss * inner)

        return angles(k, lam, next_lambda)

    def finish(k: Column, lam: Column) -> Column:
        def distance(v: Column) -> Column:
            u2 = v.c2a * (WGS84_A**2 - _B**2) / _B**2
            big_a = 1.0 + u2 / 16384.0 * (4096.0 + u2 * (u2 * (320.0 - 175.0 * u2) - 768.0))
            big_b = u2 / 1024.0 * (256.0 + u2 * (u2 * (74.0 - 47.0 * u2) - 128.0))
            cm2 = v.cm * v.cm
            delta = (
                big_b
                * v.ss
                * (
                    v.cm
                    + big_b
                    / 4.0
                    * (
                        v.cs * (2.0 * cm2 - 1.0)
                        - big_b / 6.0 * v.cm * (4.0 * v.ss * v.ss - 3.0) * (4.0 * cm2 - 3.0)
                    )
                )
            )
            return _B * big_a * (v.sigma - delta)

        return angles(k, lam, distance)

    def solve(k: Column) -> Column:
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(_VINCENTY_STEPS)),
            F.struct(k.dl.alias("now"), k.dl.alias("before")),
            lambda s, _: F.when(F.abs(s.now - s.before) + F.when(_ == 1, 1.0).otherwise(0.0) < 1e-13, s)
            .otherwise(F.struct(step(k, s.now).alias("now"), s.now.alias("before"))),
        )
        return bind(
            state,
            lambda s: F.when(F.abs(s.now - s.before) < 1e-9, finish(k, s.now)).otherwise(
                haversine(lat1, lon1, lat2, lon2)
            ),
        )

    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(bind(base, solve))


def _segments(line: Column, measure: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``measure`` over consecutive vertices."""

    def total(v: Column) -> Column:
        n = F.size(v)
        steps = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            steps,
            F.lit(0.0),
            lambda acc, i: acc + measure(F.element_at(v, i - 1), F.element_at(v, i)),
        )

    return bind(line, total)


def line_length(line: Column, ellipsoidal: bool = False) -> Column:
    if ellipsoidal:
        return _segments(line, lambda p, q: geodesic_distance(p.x, p.y, q.x, q.y))
    return _segments(line, lambda p, q: planar_distance(p.x, p.y, q.x, q.y))


def multiline_length(parts: Column, ellipsoidal: bool = False) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + line_length(p, ellipsoidal))


def _around(ring: Column, measure: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``measure`` over each vertex and the one after it, the first again after the last."""

    def total(v: Column) -> Column:
        after = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
        summed = F.aggregate(F.zip_with(v, after, measure), F.lit(0.0), lambda acc, t: acc + t)
        return F.when(v.isNull(), 0.0).otherwise(summed)

    return bind(ring, total)


def ring_area(ring: Column, ellipsoidal: bool = False) -> Column:
    """Area of one closed or open ring, square layer units or square metres."""
    if not ellipsoidal:
        return F.abs(_around(ring, lambda p, q: p.x * q.y - q.x * p.y)) / 2.0
    radius2 = WGS84_A**2 / 2.0 * (1.0 + (1.0 - _E2) / (2.0 * _E) * math.log((1 + _E) / (1 - _E)))
    q_pole = 1.0 + (1.0 - _E2) / (2.0 * _E) * math.log((1 + _E) / (1 - _E))

    def authalic_sine(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        es = s * _E
        return (
            (1.0 - _E2) * (s / (1.0 - es * es) + F.log((1.0 + es) / (1.0 - es)) / (2.0 * _E)) / q_pole
        )

    strip = _around(
        ring,
        lambda p, q: F.radians(q.x - p.x) * (authalic_sine(p.y) + authalic_sine(q.y)) / 2.0,
    )
    return F.abs(strip) * radius2


def polygon_area(rings: Column, ellipsoidal: bool = False) -> Column:
    """Outer ring minus holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    outer = ring_area(F.element_at(rings, 1), ellipsoidal)
    return F.aggregate(holes, outer, lambda acc, r: acc - ring_area(r, ellipsoidal))


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a simple ring; the vertex mean where the area is 0."""

    def add(v: Column, acc: Column, i: Column) -> Column:
        p, q = F.element_at(v, i - 1), F.element_at(v, i)
        return bind(
            p.x * q.y - q.x * p.y,
            lambda k: F.struct(
                (acc.a + k).alias("a"),
                (acc.x + (p.x + q.x) * k).alias("x"),
                (acc.y + (p.y + q.y) * k).alias("y"),
            ),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = bind(
        F.concat(ring, F.slice(ring, 1, 1)),
        lambda v: F.aggregate(
            F.sequence(F.lit(2), F.size(v)), zero, lambda acc, i: add(v, acc, i)
        ),
    )
    count = F.size(ring)
    mean_x = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p.x) / count
    mean_y = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p.y) / count
    return bind(
        sums,
        lambda s: F.when(s.a == 0, point(mean_x, mean_y)).otherwise(
            point(s.x / (3.0 * s.a), s.y / (3.0 * s.a))
        ),
    )


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring."""

    def odd(v: Column) -> Column:
        def crosses(i: Column) -> Column:
            p, q = F.element_at(v.ring, i - 1), F.element_at(v.ring, i)
            return ((p.y > v.y) != (q.y > v.y)) & (
                v.x < (q.x - p.x) * (v.y - p.y) / (q.y - p.y) + p.x
            )

        hits = F.filter(F.sequence(F.lit(2), F.size(v.ring)), crosses)
        return F.size(hits) % 2 == 1

    closed = F.concat(ring, F.slice(ring, 1, 1))
    return bind(F.struct(px.alias("x"), py.alias("y"), closed.alias("ring")), odd)


def in_polygon(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd test over all rings, so holes are outside."""
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != in_ring(px, py, r))


def ring_distance(px: Column, py: Column, rings: Column) -> Column:
    """Distance from a point to the nearest edge."""

    def edge(p: Column, q: Column) -> Column:
        dx, dy = q.x - p.x, q.y - p.y
        len2 = dx * dx + dy * dy
        t = F.when(len2 == 0, 0.0).otherwise(
            F.least(F.greatest(((px - p.x) * dx + (py - p.y) * dy) / len2, F.lit(0.0)), F.lit(1.0))
        )
        return F.hypot(px - (p.x + t * dx), py - (p.y + t * dy))

    def nearest(ring: Column) -> Column:
        return bind(
            F.concat(ring, F.slice(ring, 1, 1)),
            lambda v: F.array_min(
                F.transform(
                    F.sequence(F.lit(2), F.size(v)),
                    lambda i: edge(F.element_at(v, i - 1), F.element_at(v, i)),
                )
            ),
        )

    return F.array_min(F.transform(rings, nearest))


def wkt_line(line: Column) -> Column:
    body = F.array_join(
        F.transform(line, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "
    )
    return F.concat(F.lit("LINESTRING ("), body, F.lit(")"))


def wkt_point(p: Column) -> Column:
    return F.concat(
        F.lit("POINT ("), F.concat_ws(" ", p.x.cast("string"), p.y.cast("string")), F.lit(")")
    )


def to_layer_units(metres: Column, geographic: bool, metres_per_unit: float = 1.0) -> Column:
    """Metres to the units of a layer: degrees, or units of a given size."""
    return metres / (METRES_PER_DEGREE if geographic else metres_per_unit)
