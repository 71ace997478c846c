"""Angle helpers as Spark columns. Azimuths are degrees, north 0, east 90.

The aggregate functions take ``over`` (a window) to run as window functions.

Opposite directions cancel to a sum of which only the last bits stay, and those decide where it points.  ``azimuth``,
``sine`` and ``cosine`` therefore take their values from the C library, as SQL engines do: the JVM's own differ from it
in the last bit.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def angular_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0..180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def axial_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two undirected lines, 0..90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def bearing_180(azimuth: Column) -> Column:
    """Direction folded to 0..180; an exact 180 stays 180."""
    az = F.pmod(azimuth, F.lit(360.0))
    return F.when(az > 180.0, az - 180.0).otherwise(az)


@F.arrow_udf(DoubleType())
def _atan2(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else math.atan2(x, y) for x, y in pairs], pa.float64())


@F.arrow_udf(DoubleType())
def _sin(a: pa.Array) -> pa.Array:
    return pa.array([x if x is None else math.sin(x) if math.isfinite(x) else math.nan for x in a.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def _cos(a: pa.Array) -> pa.Array:
    return pa.array([x if x is None else math.cos(x) if math.isfinite(x) else math.nan for x in a.to_pylist()], pa.float64())


def sine(azimuth: Column) -> Column:
    return _sin(F.radians(azimuth))


def cosine(azimuth: Column) -> Column:
    return _cos(F.radians(azimuth))


def azimuth(dx: Column, dy: Column) -> Column:
    # Always over 360 and back, so that the last bit does not depend on the sign.
    return (F.degrees(_atan2(dx.cast("double"), dy.cast("double"))) % 360.0 + 360.0) % 360.0


def from_sums(s: Column, c: Column) -> Column:
    """Direction of the vector (sum of sines, sum of cosines)."""
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def axial_from_sums(s2: Column, c2: Column) -> Column:
    return F.pmod(from_sums(s2, c2) / 2.0, F.lit(180.0))


def _total(col: Column, over: WindowSpec | None) -> Column:
    total = F.sum(col)
    return total if over is None else total.over(over)


def _sums(col: Column, factor: float, weight: Column | None, over: WindowSpec | None):
    rad = F.radians(col * factor)
    weight = F.lit(1.0) if weight is None else F.when(col.isNotNull(), weight)
    return _total(F.sin(rad) * weight, over), _total(F.cos(rad) * weight, over)


def circular_mean(col: Column, over: WindowSpec | None = None) -> Column:
    """Mean direction, 0 for an empty set."""
    return F.coalesce(from_sums(*_sums(col, 1.0, None, over)), F.lit(0.0))


def axial_mean(col: Column, over: WindowSpec | None = None) -> Column:
    return F.coalesce(axial_from_sums(*_sums(col, 2.0, None, over)), F.lit(0.0))


def circular_mean_w(col: Column, weight: Column, over: WindowSpec | None = None) -> Column:
    """Weighted mean direction; the plain mean where the weights sum to 0."""
    total = _total(F.when(col.isNotNull(), weight), over)
    weighted = from_sums(*_sums(col, 1.0, weight, over))
    return F.when(total == 0, circular_mean(col, over)).otherwise(F.coalesce(weighted, F.lit(0.0)))


def axial_mean_w(col: Column, weight: Column, over: WindowSpec | None = None) -> Column:
    total = _total(F.when(col.isNotNull(), weight), over)
    weighted = axial_from_sums(*_sums(col, 2.0, weight, over))
    return F.when(total == 0, axial_mean(col, over)).otherwise(F.coalesce(weighted, F.lit(0.0)))


def _variance(col: Column, factor: float, over: WindowSpec | None) -> Column:
    s, c = _sums(col, factor, None, over)
    n = F.count(col)
    n = n if over is None else n.over(over)
    return F.when(n == 0, 1.0).otherwise(1.0 - F.hypot(s / n, c / n))


def circular_var(col: Column, over: WindowSpec | None = None) -> Column:
    """1 minus the mean resultant length; 1 for an empty set."""
    return _variance(col, 1.0, over)


def axial_var(col: Column, over: WindowSpec | None = None) -> Column:
    return _variance(col, 2.0, over)
