"""Coordinate systems as column expressions: geographic, UTM and Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.geo import WGS84_A, WGS84_F, bind, point

# EPSG codes of the supported systems.
GEOGRAPHIC = {4326: "WGS 84", 4674: "SIRGAS 2000", 4979: "WGS 84 3D"}
WEB_MERCATOR = 3857
UTM_LETTERS = "CDEFGHJKLMNPQRSTUVWX"

_N = WGS84_F / (2.0 - WGS84_F)
_RADIUS = WGS84_A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_K0 = 0.9996
_E = math.sqrt(WGS84_F * (2.0 - WGS84_F))
# Krueger series to fourth order in the third flattening.
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]


def is_geographic(srid: int) -> bool:
    return srid in GEOGRAPHIC


def utm_of(srid: int) -> tuple[int, bool] | None:
    """(zone, south) of a UTM code, None for any other code."""
    for base, first, last, south in (
        (32600, 1, 60, False),
        (32700, 1, 60, True),
        (31960, 17, 25, True),
        (31954, 11, 22, False),
    ):
        if first <= srid - base <= last:
            return srid - base, south
    return None


def utm_forward(lon: Column, lat: Column, central: Column, south: Column) -> Column:
    """Geographic degrees to a UTM point."""
    phi, dl = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    start = F.struct(
        F.atan2(t, F.cos(dl)).alias("xi"), F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t)).alias("eta")
    )

    def project(v: Column) -> Column:
        xi, eta = v.xi, v.eta
        north, east = xi, eta
        for j, a in enumerate(_ALPHA, 1):
            north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
            east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        return point(
            500000.0 + _K0 * _RADIUS * east,
            _K0 * _RADIUS * north + F.when(south, 10000000.0).otherwise(0.0),
        )

    return bind(start, project)


def utm_inverse(x: Column, y: Column, central: Column, south: Column) -> Column:
    """UTM metres to a geographic point."""
    start = F.struct(
        ((y - F.when(south, 10000000.0).otherwise(0.0)) / (_K0 * _RADIUS)).alias("xi"),
        ((x - 500000.0) / (_K0 * _RADIUS)).alias("eta"),
    )

    def unproject(v: Column) -> Column:
        xi, eta = v.xi, v.eta
        p, q = xi, eta
        for j, b in enumerate(_BETA, 1):
            p = p - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
            q = q - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        return bind(F.struct(p.alias("p"), q.alias("q")), latitude)

    def latitude(v: Column) -> Column:
        chi = F.asin(F.sin(v.p) / F.cosh(v.q))
        # Conformal to geodetic latitude by fixed-point steps on the isometric latitude.
        psi = F.atanh(F.sin(chi))
        sine = F.aggregate(
            F.sequence(F.lit(1), F.lit(7)),
            F.sin(chi),
            lambda acc, _: F.tanh(psi + _E * F.atanh(_E * acc)),
        )
        return point(central + F.degrees(F.atan2(F.sinh(v.q), F.cos(v.p))), F.degrees(F.asin(sine)))

    return bind(start, unproject)


def zone_of(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0).cast("int") + 1


def central_meridian(zone: Column) -> Column:
    return zone.cast("double") * 6.0 - 183.0


def _to_wgs84(x: Column, y: Column, srid: int) -> Column:
    if is_geographic(srid):
        return point(x, y)
    if srid == WEB_MERCATOR:
        return point(
            F.degrees(x / WGS84_A), F.degrees(2.0 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2.0)
        )
    utm = utm_of(srid)
    if utm is None:
        raise ValueError(f"unsupported coordinate system {srid}")
    return utm_inverse(x, y, F.lit(utm[0] * 6.0 - 183.0), F.lit(utm[1]))


def _from_wgs84(lon: Column, lat: Column, srid: int) -> Column:
    if is_geographic(srid):
        return point(lon, lat)
    if srid == WEB_MERCATOR:
        return point(
            F.radians(lon) * WGS84_A, F.log(F.tan(math.pi / 4.0 + F.radians(lat) / 2.0)) * WGS84_A
        )
    utm = utm_of(srid)
    if utm is None:
        raise ValueError(f"unsupported coordinate system {srid}")
    return utm_forward(lon, lat, F.lit(utm[0] * 6.0 - 183.0), F.lit(utm[1]))


def transform_point(x: Column, y: Column, src: int, dst: int) -> Column:
    if src == dst or (is_geographic(src) and is_geographic(dst)):
        return point(x, y)
    return bind(_to_wgs84(x, y, src), lambda p: _from_wgs84(p.x, p.y, dst))


def reproject(df: DataFrame, geom: str, src: int, dst: int, kind: str = "point") -> DataFrame:
    """Reproject a point, line (array) or multi-part (array of arrays) column."""
    if src == dst:
        return df.withColumn("srid", F.lit(dst))

    def one(p: Column) -> Column:
        return transform_point(p.x, p.y, src, dst)

    g = F.col(geom)
    moved = {
        "point": lambda: one(g),
        "line": lambda: F.transform(g, one),
        "multi": lambda: F.transform(g, lambda part: F.transform(part, one)),
    }[kind]()
    return df.withColumn(geom, moved).withColumn("srid", F.lit(dst))


def ensure_crs(df: DataFrame, geom: str, srid: int, kind: str = "point", current: int = 4326):
    """Reproject unless the layer is already in ``srid``."""
    return df if current == srid else reproject(df, geom, current, srid, kind)


def dms_text(value: Column) -> Column:
    """Degrees as d°m's.sss" text; the sign goes in front."""
    a = F.abs(value)
    deg = F.floor(a)
    minutes = F.floor((a - deg) * 60.0)
    seconds = ((a - deg) * 60.0 - minutes) * 60.0
    return F.format_string(
        "%s%d°%d'%.3f\"", F.when(value < 0, "-").otherwise(""), deg, minutes, seconds
    )


def utm_letter(lat: Column) -> Column:
    idx = F.least(F.floor((lat + 80.0) / 8.0).cast("int"), F.lit(len(UTM_LETTERS) - 1))
    return F.when((lat < -80) | (lat > 84), "").otherwise(
        F.substring(F.lit(UTM_LETTERS), idx + 1, F.lit(1))
    )


def coordinate_info(df: DataFrame, x: str, y: str, srid: int = 4326) -> DataFrame:
    """Latitude/longitude, DMS text and UTM position of every point."""
    wgs = _to_wgs84(F.col(x), F.col(y), srid)
    lon, lat = F.col("_wgs.x"), F.col("_wgs.y")
    zone = zone_of(lon)
    south = lat < 0
    utm = utm_forward(lon, lat, central_meridian(zone), south)
    return (
        df.withColumn("_wgs", wgs)
        .withColumn("_utm", utm)
        .withColumns(
            {
                "lat": lat,
                "lon": lon,
                "lat_dms": dms_text(lat),
                "lon_dms": dms_text(lon),
                "utm_x": F.col("_utm.x"),
                "utm_y": F.col("_utm.y"),
                "zone": zone,
                "zone_letter": utm_letter(lat),
                "hemisphere": F.when(south, "Sul").otherwise("Norte"),
                "epsg": F.when(south, F.lit(31960)).otherwise(F.lit(31954)) + zone,
            }
        )
        .drop("_wgs", "_utm")
    )


def dms_to_decimal(parts: Column, ref: Column) -> Column:
    """[deg, min, sec] with plain or "n/d" entries to signed degrees; null if malformed."""

    def number(text: Column) -> Column:
        text = F.trim(text.cast("string"))
        num, den = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
        n, d = num.try_cast("double"), den.try_cast("double")
        ratio = F.when(d == 0, F.when(n.isNotNull(), 0.0)).otherwise(F.try_divide(n, d))
        return F.when(text.contains("/"), ratio).otherwise(text.try_cast("double"))

    value = (
        number(F.get(parts, F.lit(0)))
        + number(F.get(parts, F.lit(1))) / 60.0
        + number(F.get(parts, F.lit(2))) / 3600.0
    )
    flip = F.upper(F.trim(F.coalesce(ref, F.lit("")))).isin("S", "W")
    return F.when(F.size(parts) >= 3, F.when(flip, -value).otherwise(value))
