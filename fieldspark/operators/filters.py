"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IN_LIST = 1000


def only_ids(df: DataFrame, ids: DataFrame | Seq, key: str) -> DataFrame:
    """Rows whose key is listed; ``ids`` is a table or a short list."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    values = list(ids)
    if len(values) <= MAX_IN_LIST:
        return df.filter(F.col(key).isin(*values))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], df.select(key).schema)
    return df.join(listed, key, "left_semi")


def extent_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """True where two boxes (xmin, ymin, xmax, ymax) share a point."""
    return (
        (a["xmin"] <= b["xmax"])
        & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"])
        & (b["ymin"] <= a["ymax"])
    )


def footprint_candidates(df: DataFrame, only_ok: bool = True) -> DataFrame:
    """Photos with GPS, gimbal angles and a height: those a footprint can be drawn for."""
    cols = set(df.columns)

    def value(*names: str) -> Column:
        found = [F.col(n) for n in names if n in cols]
        return F.coalesce(*found) if found else F.lit(None)

    keep = F.coalesce(value("HasExifGps").cast("boolean"), F.lit(False))
    if only_ok:
        keep = keep & F.coalesce(value("QualityFlag") == "OK", F.lit(False))
    for names in (
        ("Lat", "GpsLatitude"),
        ("Lon", "GpsLongitude"),
        ("GimbalYawDegree",),
        ("GimbalPitchDegree",),
        ("GimbalRollDegree",),
    ):
        keep = keep & value(*names).isNotNull()
    height = value("RelativeAltitude").cast("string").try_cast("double")
    return df.filter(keep & F.coalesce(height != 0, F.lit(False)))


def enabled(rules: dict[str, dict]) -> dict[str, dict]:
    """Rules not switched off."""
    return {k: v for k, v in rules.items() if v.get("enabled", True)}
