"""Capture pipeline of drone photos: time, sequence, optics, scores and quality index."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.catalog import (
    DEFAULT_CAMERA,
    EV_CLASSES,
    LIGHT_RANGES,
    camera_of,
    canonical_key,
    canonical_name,
    light_label,
)
from fieldspark.functions.rules import THRESHOLDS, level_of, message_of
from fieldspark.functions.text import (
    CAPTURE_FORMATS,
    file_uri,
    finite,
    finite_num,
    is_missing,
    parse_ts,
    plain_num,
    present,
)
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence
from fieldspark.plans.quantiles import order_statistics

MAX_SECONDS, MAX_ALTITUDE, MAX_SHUTTER = 120, 200, 5000
TURN_DEGREES, IDEAL_OVERLAP, SHUTTER_LIFE = 150, 60.0, 400_000
FULL_FRAME_DIAGONAL = 43.2666


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def raw(df: DataFrame, *names: str) -> Column:
    """First non-null of the columns that exist."""
    found = [F.col(f"`{n}`").cast("string") for n in names if has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def num(df: DataFrame, *names: str, default: float | None = 0.0) -> Column:
    """First non-null of the columns as a number; text is parsed, "+" signs ignored."""
    kinds = dict(df.dtypes)
    found = [n for n in names if n in kinds]
    if all(kinds[n] in _NUMBERS for n in found):
        cols = [F.col(f"`{n}`").cast("double") for n in found]
        value = F.coalesce(*cols) if cols else F.lit(None).cast("double")
    else:
        value = plain_num(raw(df, *names))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def finite_field(df: DataFrame, *names: str) -> Column:
    """First of the columns as a finite number, null otherwise; numbers are not re-parsed."""
    kinds = dict(df.dtypes)
    found = [n for n in names if n in kinds]
    if all(kinds[n] in _NUMBERS for n in found):
        cols = [F.col(f"`{n}`").cast("double") for n in found]
        value = F.coalesce(*cols) if cols else F.lit(None).cast("double")
        return F.when(finite(value), value)
    return finite_num(raw(df, *names))


_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")
# Fields that are numbers wherever they are read.
NUMERIC_FIELDS = (
    "GpsLatitude", "GpsLongitude", "GpsLatitudeXmp", "GpsLongitudeXmp", "Lat", "Lon", "Alt", "AbsoluteAltitude",
    "RelativeAltitude", "GimbalYawDegree", "GimbalPitchDegree", "GimbalRollDegree", "FlightYawDegree",
    "FlightPitchDegree", "FlightRollDegree", "FlightXSpeed", "FlightYSpeed", "FlightZSpeed", "XSpeed", "YSpeed",
    "ZSpeed", "ExposureTime", "FNumber", "FocalLength", "ISOSpeedRatings", "FocusDistance", "ExifImageWidth",
    "ExifImageHeight", "LRFTargetDistance", "LRFTargetLat", "LRFTargetLon", "RtkStdLon", "RtkStdLat", "RtkStdHgt",
    "RtkDiffAge", "SensorTemperature", "LensTemperature", "ShutterCount", "SizeMb", "WhiteBalanceCCT",
)


def with_numbers(df: DataFrame, fields: Seq[str] = NUMERIC_FIELDS) -> DataFrame:
    """Parse the numeric text fields once, so later steps work on doubles."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: num(df, n, default=None) for n in fields if kinds.get(n) == "string"})


def canonicalize_columns(df: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Rename columns to canonical names; several spellings merge, filled values win."""
    merged: dict[str, list[str]] = {}
    for c in df.columns:
        name = canonical_name(c) or (c if keep_unknown else None)
        if name:
            merged.setdefault(name, []).append(c)
    out = []
    for name, sources in merged.items():
        if len(sources) == 1:
            out.append(F.col(f"`{sources[0]}`").alias(name))
        else:
            texts = [F.col(f"`{s}`").cast("string") for s in sources]
            out.append(F.coalesce(*[F.when(t != "", t) for t in texts]).alias(name))
    return df.select(*out)


def canonicalize_map(attributes: Column) -> Column:
    """Map with canonical keys; unknown keys and empty values drop, the first value wins."""
    pairs = F.transform(
        F.map_entries(attributes),
        lambda e: F.struct(canonical_key(e.key).alias("key"), e.value.alias("value")),
    )
    kept = F.filter(pairs, lambda e: e.key.isNotNull() & e.value.isNotNull() & (e.value != ""))
    keys = F.array_distinct(F.transform(kept, lambda e: e.key))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k, F.element_at(F.filter(kept, lambda e: e.key == k), 1).value),
        )
    )


def resolve_capture_ts(df: DataFrame) -> DataFrame:
    """Add CaptureTs and CaptureSource and fill the four date fields from it."""
    candidates = ["DateTimeOriginal", "DateTime", "UTCAtExposure", "DtFull"]
    date, time = F.trim(raw(df, "DtDate")), F.trim(raw(df, "DtTime"))
    joined = F.when(
        ~is_missing(date) & (F.coalesce(time, F.lit("")) != ""),
        F.concat(date, F.lpad(time, 4, "0")),
    )
    parsed = [(n, parse_ts(present(raw(df, n)), CAPTURE_FORMATS)) for n in candidates]
    parsed.append(("DtDate+DtTime", parse_ts(joined, CAPTURE_FORMATS)))
    ts = F.coalesce(*[p for _, p in parsed])
    source = F.coalesce(*[F.when(p.isNotNull(), F.lit(n)) for n, p in parsed])
    out = df.withColumns({"CaptureTs": ts, "CaptureSource": source})
    fills = {
        "DateTimeOriginal": "yyyy:MM:dd HH:mm:ss",
        "DtFull": "yyyyMMddHHmm",
        "DtDate": "yyyyMMdd",
        "DtTime": "HHmm",
    }
    filled = {}
    for name, layout in fills.items():
        have = raw(df, name)
        empty = have.isNull() | have.isin("", "None", "null")
        filled[name] = F.when(empty, F.date_format("CaptureTs", layout)).otherwise(have)
    return out.withColumns(filled)


def flight_id(df: DataFrame, kind: str = "serial") -> Column:
    """``serial``: drone and camera serial plus date; ``mrk``: stem of the position log."""
    if kind == "mrk":
        stem = F.regexp_replace(F.trim(raw(df, "MrkFile")), r"(?i)_Timestamp\.MRK$", "")
        stem = F.regexp_replace(stem, r"(?i)\.MRK$", "")
        return F.when(F.coalesce(stem, F.lit("")) == "", "unknown").otherwise(stem)
    unknown = F.lit("UNKNOWN")
    return F.concat_ws(
        "_",
        F.substring(F.coalesce(raw(df, "DroneSerialNumber"), unknown), 1, 8),
        F.substring(F.coalesce(raw(df, "CameraSerialNumber"), unknown), 1, 8),
        F.coalesce(F.date_format("CaptureTs", "yyyy-MM-dd"), F.lit("UNKNOWN_DATE")),
    )


def with_camera(df: DataFrame) -> DataFrame:
    """Sensor, focal length and image size of the camera; a default for unknown models."""
    cam = camera_of(raw(df, "DroneModel", "Model"))
    d = df.withColumn("_cam", cam)
    c = F.col("_cam")
    w, h, f, pw, ph = DEFAULT_CAMERA
    img_w, img_h = num(df, "ExifImageWidth", default=pw), num(df, "ExifImageHeight", default=ph)
    from_model = (img_w <= 0) & c.isNotNull()
    width = F.when(from_model, c.pw).otherwise(img_w)
    height = F.when(from_model, c.ph).otherwise(img_h)
    focal = num(df, "FocalLength")
    return d.withColumns(
        {
            "SensorWidth": F.coalesce(c.w, F.lit(w)),
            "SensorHeight": F.coalesce(c.h, F.lit(h)),
            "FocalUsed": F.when(focal > 0, focal).otherwise(F.coalesce(c.f, F.lit(f))),
            "ImageWidth": F.when(width > 0, width).otherwise(float(pw)),
            "ImageHeight": F.when(height > 0, height).otherwise(float(ph)),
        }
    ).drop("_cam")


def incidence_angle(df: DataFrame) -> Column:
    pitch = num(df, "GimbalPitchDegree") + num(df, "FlightPitchDegree")
    return F.abs(90.0 - F.abs(pitch))


def effective_height(df: DataFrame) -> Column:
    """Laser range projected to the vertical, else relative, else absolute altitude."""
    lrf = num(df, "LRFTargetDistance")
    relative, absolute = num(df, "RelativeAltitude"), num(df, "AbsoluteAltitude")
    return (
        F.when(lrf > 0, lrf * F.cos(F.radians(incidence_angle(df))))
        .when(relative > 0, relative)
        .when(absolute > 0, absolute)
        .otherwise(0.0)
    )


def speed_3d(df: DataFrame, prefix: str = "") -> Column:
    total = F.lit(0.0)
    for axis in "XYZ":
        total = total + F.pow(num(df, f"{prefix}Flight{axis}Speed", f"{prefix}{axis}Speed"), 2)
    return F.sqrt(total)


def r2(c: Column) -> Column:
    return F.bround(c, 2)


def ground_coverage(df: DataFrame) -> DataFrame:
    """Ground width and height of a photo; needs ``with_camera``."""
    d = df.withColumn("_h", effective_height(df))
    ok = (F.col("_h") > 0) & (F.col("FocalUsed") > 0)
    scale = F.col("_h") / F.col("FocalUsed")
    return d.withColumns(
        {
            "CoverageWidth": F.when(ok, r2(scale * F.col("SensorWidth"))).otherwise(0.0),
            "CoverageHeight": F.when(ok, r2(scale * F.col("SensorHeight"))).otherwise(0.0),
        }
    ).drop("_h")


def optics(df: DataFrame, shutter_life: int = SHUTTER_LIFE) -> DataFrame:
    """Ground sample distance, blur, exposure, depth of field and related values."""
    d = df.withColumns(
        {
            "_h": effective_height(df),
            "_v": speed_3d(df),
            "_t": num(df, "ExposureTime"),
            "_n": num(df, "FNumber", default=2.8),
            "_iso": num(df, "ISOSpeedRatings", default=100),
            "_u": num(df, "FocusDistance") * 1000.0,
            "_diag": F.hypot("SensorWidth", "SensorHeight"),
        }
    )
    h, f = F.col("_h"), F.col("FocalUsed")
    seen = (h > 0) & (f > 0)
    gx = F.when(seen, h * F.col("SensorWidth") / (f * F.col("ImageWidth")) * 100).otherwise(0.0)
    gy = F.when(seen, h * F.col("SensorHeight") / (f * F.col("ImageHeight")) * 100).otherwise(0.0)
    d = d.withColumn("_gsd", F.when((gx > 0) & (gy > 0), (gx + gy) / 2).otherwise(F.greatest(gx, gy)))
    s, lens = num(df, "SensorTemperature"), num(df, "LensTemperature")
    heat = F.when((s > 0) & (lens > 0), (s + lens) / 2).when(s != 0, s).otherwise(lens)
    t, n, u, diag = F.col("_t"), F.col("_n"), F.col("_u"), F.col("_diag")
    coc = diag / 1730.0
    return d.withColumns(
        {
            "ShutterLifePct": r2(num(df, "ShutterCount") / float(shutter_life) * 100),
            "GroundSampleDistanceCm": r2(F.col("_gsd")),
            "TotalHeatIndex": r2(heat),
            "MotionBlurRisk": F.when(
                F.col("_gsd") > 0, r2(F.col("_v") * t / (F.col("_gsd") / 100))
            ).otherwise(0.0),
            "ExposureValueEv": F.when(t > 0, r2(F.log2(n * n / t))).otherwise(0.0),
            "FOV": F.when(f > 0, r2(2 * F.degrees(F.atan(diag / (2 * f))))).otherwise(0.0),
            "CircleOfConfusion": F.bround(coc, 6),
            "DOF": F.when(
                (f > 0) & (n > 0) & (u > 0), r2(2.0 * u * u * n * coc / (f * f) / 1000.0)
            ).otherwise(0.0),
            "HyperfocalDistance": F.when((f > 0) & (n > 0), r2(f * f / (n * coc) / 1000.0)).otherwise(0.0),
            "LightValue": F.when(
                (n > 0) & (t > 0) & (F.col("_iso") > 0), r2(F.log2(n * n * 100.0 / (t * F.col("_iso"))))
            ).otherwise(0.0),
            "FocalLength35efl": F.when(f > 0, r2(f * (FULL_FRAME_DIAGONAL / diag))).otherwise(0.0),
        }
    ).drop("_h", "_v", "_t", "_n", "_iso", "_u", "_diag", "_gsd")


def gimbal_offset(gimbal_yaw: Column, flight_yaw: Column) -> Column:
    diff = F.abs(F.pmod(gimbal_yaw, F.lit(360.0)) - F.pmod(flight_yaw, F.lit(360.0)))
    return (
        F.when((diff > 150) & (diff < 300), F.abs(180.0 - diff))
        .when(diff > 300, F.abs(360.0 - diff))
        .otherwise(diff)
    )


def orientation(df: DataFrame, direction: Column | None = None) -> DataFrame:
    """Gimbal offset, speed, yaw alignment, relative yaw and view class."""
    gim, yaw, pitch = num(df, "GimbalYawDegree"), num(df, "FlightYawDegree"), num(df, "GimbalPitchDegree")
    move = yaw if direction is None else F.coalesce(direction, yaw)
    error = F.least(F.abs(yaw - move), 360.0 - F.abs(yaw - move))
    relative = r2(F.pmod(gim - yaw, F.lit(360.0)))
    speed = speed_3d(df)
    d = df.withColumns(
        {
            "GimbalOffset": r2(gimbal_offset(gim, yaw)),
            "3DSpeed": r2(speed),
            "Speed3dKmh": F.bround(speed * 3.6, 1),
            "YawAlignmentError": r2(error),
            "YawRelativeError": relative,
            "Directory": file_uri(raw(df, "Path")),
        }
    )
    y = F.col("YawRelativeError")
    side = (
        F.when((y >= 315) | (y < 45), "Obliqua - Frente")
        .when(y < 135, "Obliqua - Direita")
        .when(y < 225, "Obliqua - Tras")
        .otherwise("Obliqua - Esquerda")
    )
    return d.withColumn("Nadir", F.when(F.abs(F.abs(pitch) - 90) <= 3, "Nadir").otherwise(side))


def rtk_label(flag: Column) -> Column:
    code = F.coalesce(flag.try_cast("int"), F.lit(0))
    return (
        F.when(code == 0, "Sem GPS")
        .when(code.between(16, 33), "RTK Single")
        .when(code.between(34, 49), "RTK Float")
        .when(code == 50, "RTK Fixed")
        .otherwise("RTK Desconhecido")
    )


def ev_class(ev: Column) -> Column:
    out = F.lit("Unknown")
    for low, high, label in reversed(EV_CLASSES):
        out = F.when(ev.between(low, high), label).otherwise(out)
    return F.when(ev.isNull() | (ev < 0), "Unknown").otherwise(out)


def light_cct_check(code: Column, cct: Column) -> Column:
    """Whether the colour temperature fits the light source."""
    ranges = {k: [float(a), float(b)] for k, (a, b) in LIGHT_RANGES.items()}
    pairs = F.create_map(
        *[x for k, v in ranges.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))]
    )
    k = F.coalesce(code.try_cast("int"), F.lit(0))
    t = F.coalesce(plain_num(cct), F.lit(0.0))
    limits = F.try_element_at(pairs, k)
    return (
        F.when((t <= 0) | limits.isNull(), "Unknown")
        .when(t.between(limits[0], limits[1]), "Consistent")
        .otherwise("Inconsistent")
    )


def label_codes(df: DataFrame) -> DataFrame:
    """Labels of light source, RTK flag and exposure, and the colour temperature check."""
    code = F.coalesce(raw(df, "LightSource").try_cast("int"), F.lit(0))
    label = light_label(code)
    out = {
        "LightSourceClassification": label,
        "LightConsistency": label,
        "LightCctCheck": light_cct_check(raw(df, "LightSource"), raw(df, "WhiteBalanceCCT")),
        "RtkType": rtk_label(raw(df, "RtkFlag")),
    }
    if has(df, "ExposureValueEv"):
        out["EvClassification"] = ev_class(F.col("ExposureValueEv"))
    return df.withColumns(out)


def mean_rtk_std(df: DataFrame, prefix: str = "") -> Column:
    names = ("RtkStdLon", "RtkStdLat", "RtkStdHgt")
    return sum((num(df, prefix + n, default=999) for n in names), F.lit(0.0)) / 3


def rtk_stability(mean_std: Column, flag: Column, previous: Column, valid_prev: Column) -> Column:
    """Against the photo before where there is one, else by the size of the deviation."""
    fixed = F.trim(F.coalesce(flag, F.lit(""))) == "50"
    ladder = (
        F.when(fixed & (mean_std < 0.01), 99.5)
        .when(fixed & (mean_std < 0.02), 95.0)
        .when(mean_std < 0.02, 90.0)
        .when(mean_std < 0.05, 80.0)
        .when(mean_std < 0.10, 60.0)
        .when(mean_std < 1.00, 30.0)
        .otherwise(5.0)
    )
    change = 100.0 - F.least(F.lit(100.0), F.abs(mean_std - previous) * 100.0)
    return F.when(valid_prev, F.greatest(F.lit(0.0), change)).otherwise(ladder)


def mrk_differences(df: DataFrame) -> DataFrame:
    """Position log minus photo position: x, y, z, planimetric and 3-D."""
    lat, lon, alt = num(df, "Lat"), num(df, "Lon"), num(df, "Alt")
    glat, glon, galt = num(df, "GpsLatitude"), num(df, "GpsLongitude"), num(df, "AbsoluteAltitude")
    some = (lat != 0) | (lon != 0) | (glat != 0) | (glon != 0)
    d = df.withColumns(
        {
            "XDifference": r2(lon - glon),
            "YDifference": r2(lat - glat),
            "ZDifference": r2(alt - galt),
            "XYDifference": F.when(some, r2(geo.haversine(lat, lon, glat, glon))).otherwise(0.0),
        }
    )
    return d.withColumn("3DDifference", r2(F.hypot("XYDifference", "ZDifference")))


_PREV = (
    "CaptureTs",
    "AbsoluteAltitude",
    "ShutterCount",
    "GimbalYawDegree",
    "RtkStdLon",
    "RtkStdLat",
    "RtkStdHgt",
    "FlightXSpeed",
    "FlightYSpeed",
    "FlightZSpeed",
    "XSpeed",
    "YSpeed",
    "ZSpeed",
)


def _turn(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d <= 180, d).otherwise(360.0 - d)


def photo_sequence(
    df: DataFrame, group: Seq[str] = ("FolderLevel1",), file: str = "File", cut: bool | None = None
) -> DataFrame:
    """Values against the photo before, in capture order inside the nearest folder.

    Adds the step in time and space, direction, trajectory smoothness, strip id
    and the change label, and ``Prev*`` columns the scores need.  Values are 0
    where the photo before is not part of the same sequence.
    """
    group = list(group)
    d = df if has(df, "CaptureTs") else resolve_capture_ts(df)
    d = d.withColumns(
        {
            "FlightKey": flight_id(d),
            "_ord": F.coalesce(F.unix_micros("CaptureTs"), F.lit(2**62)),
            "_lat": num(d, "GpsLatitude", "LRFTargetLat"),
            "_lon": num(d, "GpsLongitude", "LRFTargetLon"),
        }
    )
    prev = [n for n in _PREV if has(d, n)]

    def steps(x: DataFrame, w) -> DataFrame:
        lagged = {f"Prev{n}": F.lag(n).over(w) for n in prev}
        lagged |= {"_pk": F.lag("FlightKey").over(w), "_plat": F.lag("_lat").over(w), "_plon": F.lag("_lon").over(w)}
        return x.withColumns(lagged)

    seq = Sequence(d, group, ["_ord", file], cut=cut).bounded(1, steps)
    x = seq.df
    dt = F.abs(F.unix_micros("CaptureTs") - F.unix_micros("PrevCaptureTs")) / 1e6
    rise = F.abs(num(x, "AbsoluteAltitude") - num(x, "PrevAbsoluteAltitude"))
    jump = F.abs(num(x, "ShutterCount") - num(x, "PrevShutterCount"))
    valid = (
        (F.col("_pk") == F.col("FlightKey"))
        & (dt <= MAX_SECONDS)
        & (rise <= MAX_ALTITUDE)
        & (jump <= MAX_SHUTTER)
    )
    x = x.withColumn("ValidPrev", F.coalesce(valid, F.lit(False)))
    ok = F.col("ValidPrev")
    dist = geo.haversine(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon"))
    x = x.withColumns({"_dt": F.when(ok, dt), "_d": F.when(ok, dist), "_rise": F.when(ok, rise)})
    x = x.withColumn("_d3", F.hypot("_d", "_rise"))
    heading = geo.bearing(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon"))
    zero = F.lit(0.0)
    x = x.withColumns(
        {
            "TimeSincePrevious": F.coalesce(r2(F.col("_dt")), zero),
            "GeodesicDistancePrevious": F.coalesce(r2(F.col("_d")), zero),
            "Distance3dPrevious": F.coalesce(r2(F.col("_d3")), zero),
            "AvgVelocityBetweenPhotos": F.coalesce(
                F.when(F.col("_dt") > 0, r2(F.col("_d3") / F.col("_dt"))), zero
            ),
            "_dir": F.when(ok, r2(heading)),
        }
    )
    seq.df = x.withColumn("DisplacementDirection", F.coalesce("_dir", zero))
    seq.last_before("_last_dir", F.col("_dir"))
    turn = F.coalesce(_turn(F.col("_dir"), F.col("_last_dir")), zero)
    seq.df = seq.df.withColumn("_turn", turn)
    seq.running(StripId=F.when(F.col("_turn") > TURN_DEGREES, 1).otherwise(0))
    out = seq.df.withColumns(
        {"StripId": F.col("StripId") + 1, "TrajectorySmoothness": r2(F.col("_turn"))}
    )
    medians = {"_mt": "TimeSincePrevious", "_md": "GeodesicDistancePrevious"}
    if not seq.cut:
        # The rows are already partitioned by the group, so this adds no shuffle.
        w = Window.partitionBy(*group)
        out = out.withColumns(
            {m: F.percentile(F.when(ok, F.col(c)), 0.5).over(w) for m, c in medians.items()}
        )
    else:
        seq.df = out
        out = seq.result()
        rows = out.filter("ValidPrev")
        for m, c in medians.items():
            mid = order_statistics(rows.select(*group, c), group, c, {m: 0.5}, cut=True)
            out = join_on(out, mid, group, "left")

    def ratio(value: str, median: str) -> Column:
        v, m = F.col(value), F.col(median)
        return F.when((m > 0) & (v > 0), v / m).otherwise(1.0)

    out = out.withColumn(
        "AbruptChangeRatio",
        F.greatest(ratio("TimeSincePrevious", "_mt"), ratio("GeodesicDistancePrevious", "_md")),
    )
    rule = THRESHOLDS["abrupt_change_flag"]
    out = out.withColumn(
        "AbruptChangeFlag", message_of(rule, level_of(rule, F.col("AbruptChangeRatio"), True))
    )
    return out.drop(
        "_ord", "_lat", "_lon", "_pk", "_plat", "_plon", "_dt", "_d", "_d3", "_rise", "_dir", "_last_dir", "_turn", "_mt", "_md"
    )


def capture_scores(df: DataFrame) -> DataFrame:
    """Overlap, stability and suitability scores; needs sequence and coverage columns."""
    ok = F.col("ValidPrev")
    height, dist = F.col("CoverageHeight"), F.col("GeodesicDistancePrevious")
    zero = F.lit(0.0)
    overlap = (
        F.when(height <= 0, 0.0)
        .when(ok, F.greatest(zero, F.least(F.lit(100.0), (1.0 - dist / height) * 100.0)))
        .otherwise(IDEAL_OVERLAP)
    )
    std = mean_rtk_std(df)
    rtk_rule = THRESHOLDS["rtk_effective_precision"]
    d = df.withColumns({"_std": std, "_ov": overlap, "IncidenceAngle": r2(incidence_angle(df))})
    d = d.withColumn("_lvl", level_of(rtk_rule, F.col("_std"), True))
    age = num(df, "RtkDiffAge", default=999)
    inc, lvl, ov = F.col("IncidenceAngle"), F.col("_lvl"), F.col("_ov")
    score = (
        F.when(lvl >= 4, 30).when(lvl == 3, 15).otherwise(0)
        + F.when(inc < 5, 25).when(inc < 15, 15).otherwise(0)
        + F.when(F.trim(F.coalesce(raw(df, "DewarpFlag"), F.lit(""))) != "0", 20).otherwise(0)
        + F.when(age < 2, 15).when(age < 5, 8).otherwise(0)
        + F.when(ov > 70, 10).when(ov > 50, 5).otherwise(0)
    )
    step = F.col("TimeSincePrevious")
    yaw = _turn(num(df, "GimbalYawDegree"), num(df, "PrevGimbalYawDegree"))
    now, before = speed_3d(df), speed_3d(df, "Prev")
    mean = (now + before) / 2
    return d.withColumns(
        {
            "RtkEffectivePrecision": message_of(rtk_rule, lvl),
            "RtkStabilityScore": r2(
                rtk_stability(F.col("_std"), raw(df, "RtkFlag"), mean_rtk_std(df, "Prev"), ok)
            ),
            "FOverlap": r2(ov),
            "IsIdealOverlap": ov >= IDEAL_OVERLAP,
            "OrthorectificationPotential": F.least(F.lit(100), score).cast("double"),
            "GimbalAngularVelocity": F.when(ok & (step > 0), r2(yaw / step)).otherwise(0.0),
            "VerticalStability": F.when(
                ok, r2(F.abs(num(df, "AbsoluteAltitude") - num(df, "PrevAbsoluteAltitude")))
            ).otherwise(0.0),
            "SpeedVariationIndex": F.when(
                ok & (mean > 0), r2(F.abs(now - before) / 2 / mean)
            ).otherwise(0.0),
            "CaptureEfficiency": F.when(ok & (height > 0), r2(dist / height)).otherwise(0.0),
        }
    ).drop("_std", "_ov", "_lvl")


@dataclass(frozen=True)
class PqiIndicator:
    """One part of the quality index: a value (or a ready level), its rule and weight."""

    name: str
    weight: float
    value: Column | None = None
    level: Column | None = None


def _comma_num(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes).get(name) in _NUMBERS:
        return F.col(f"`{name}`").cast("double")
    return F.replace(raw(df, name), F.lit(","), F.lit(".")).try_cast("double")


def default_pqi(df: DataFrame) -> list[PqiIndicator]:
    stds = [_comma_num(df, n) for n in ("RtkStdLon", "RtkStdLat", "RtkStdHgt")]
    count = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in stds), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in stds), F.lit(0.0))
    rtk = F.when(count >= 2, level_of(THRESHOLDS["rtk_effective_precision"], total / count, True)).otherwise(3)
    dewarp = F.when(F.trim(F.coalesce(raw(df, "DewarpFlag"), F.lit(""))) == "0", 1).otherwise(5)
    return [
        PqiIndicator("motion_blur_risk", 0.25, _comma_num(df, "MotionBlurRisk")),
        PqiIndicator("predicted_overlap", 0.25, _comma_num(df, "FOverlap")),
        PqiIndicator("speed_3d_ms", 0.5, _comma_num(df, "3DSpeed")),
        PqiIndicator(
            "ev_classification", 2.0, F.coalesce(F.trim(raw(df, "EvClassification")), F.lit("Unknown"))
        ),
        PqiIndicator("rtk_effective_precision", 1.0, level=rtk),
        PqiIndicator("xy_difference", 1.0, _comma_num(df, "XYDifference")),
        PqiIndicator("z_difference", 1.0, _comma_num(df, "ZDifference")),
        PqiIndicator("dewarp_flag", 2.0, level=dewarp),
        PqiIndicator("rtk_diff_age", 1.5, _comma_num(df, "RtkDiffAge")),
    ]


def pqi(
    df: DataFrame,
    rules: dict = THRESHOLDS,
    indicators: list[PqiIndicator] | None = None,
    out: str = "PhotogrammetryQualityIndex",
    details: bool = False,
) -> DataFrame:
    """Weighted score 0..100 of the indicator levels; a missing value counts as level 3."""
    parts = indicators if indicators is not None else default_pqi(df)
    levels = {}
    for p in parts:
        lvl = p.level if p.level is not None else level_of(rules[p.name], p.value, True)
        levels[p.name] = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(lvl, F.lit(3))))
    total = sum((((levels[p.name] - 1) * 25.0) * p.weight for p in parts), F.lit(0.0))
    weight = sum(p.weight for p in parts)
    score = r2(total / weight) if weight > 0 else F.lit(50.0)
    cols = {out: F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))}
    if details:
        cols["pqi_levels"] = F.create_map(*[x for n, c in levels.items() for x in (F.lit(n), c)])
    return df.withColumns(cols)


def pqi_label(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excelente")
        .when(score >= 80, "Muito boa")
        .when(score >= 70, "Aceitável")
        .when(score >= 50, "Risco moderado")
        .otherwise("Problemática")
    )


def photo_pipeline(df: DataFrame, group: Seq[str] = ("FolderLevel1",), file: str = "File") -> DataFrame:
    """The whole capture pipeline: time, sequence, optics, orientation, scores, index."""
    d = photo_sequence(resolve_capture_ts(with_numbers(df)), group, file)
    d = optics(ground_coverage(with_camera(d)))
    d = orientation(d, F.when(F.col("ValidPrev"), F.col("DisplacementDirection")))
    d = mrk_differences(label_codes(capture_scores(d)))
    fly, absolute = effective_height(d), num(d, "AbsoluteAltitude")
    d = d.withColumns(
        {
            "FlightAltitude": r2(fly),
            "GroundElevation": F.when((fly > 0) & (absolute > 0), r2(absolute - fly)).otherwise(0.0),
        }
    )
    d = pqi(d)
    speeds = {
        n: F.abs(num(d, n, default=None))
        for n in ("FlightXSpeed", "FlightYSpeed", "FlightZSpeed", "XSpeed", "YSpeed", "ZSpeed")
        if has(d, n)
    }
    helpers = [f"Prev{n}" for n in _PREV if has(d, f"Prev{n}")]
    helpers += ["SensorWidth", "SensorHeight", "FocalUsed", "ImageWidth", "ImageHeight"]
    return d.withColumns(speeds).drop(*helpers)


def resolve_position(df: DataFrame) -> DataFrame:
    """Point from photo GPS numbers, GPS degrees-minutes-seconds, or the position log."""
    from fieldspark.functions.crs import dms_to_decimal

    def dms(name: str, ref: str) -> Column:
        if not has(df, name):
            return F.lit(None).cast("double")
        kind = dict(df.dtypes)[name]
        if kind.startswith("array"):
            parts = F.transform(name, lambda p: p.cast("string"))
        else:
            parts = F.split(F.regexp_replace(raw(df, name), r"[\[\]()\s]", ""), ",")
        return dms_to_decimal(parts, raw(df, ref))

    def number(name: str) -> Column:
        if has(df, name) and dict(df.dtypes)[name].startswith("array"):
            return F.lit(None).cast("double")
        return num(df, name, default=None)

    def pair(lat: Column, lon: Column) -> Column:
        return F.when(lat.isNotNull() & lon.isNotNull(), geo.point(lon, lat))

    gps = pair(number("GpsLatitude"), number("GpsLongitude"))
    from_dms = pair(dms("GpsLatitude", "GpsLatitudeRef"), dms("GpsLongitude", "GpsLongitudeRef"))
    log = pair(num(df, "Lat", default=None), num(df, "Lon", default=None))
    return df.withColumn("geom", F.coalesce(gps, from_dms, log))


def coord_source(df: DataFrame) -> Column:
    """Where a photo's position comes from: MRK, XMP, EXIF or NONE."""
    log = num(df, "Lat", default=None).isNotNull() & num(df, "Lon", default=None).isNotNull()
    xmp = num(df, "GpsLatitudeXmp", default=None).isNotNull() & num(df, "GpsLongitudeXmp", default=None).isNotNull()
    exif = raw(df, "GpsLatitude").isNotNull() & raw(df, "GpsLongitude").isNotNull()
    return F.when(log, "MRK").when(xmp, "XMP").when(exif, "EXIF").otherwise("NONE")


def match_mrk(photos: DataFrame, mrk: DataFrame, keys: Seq[str] = (), file: str = "File") -> DataFrame:
    """Give each photo the position-log point with its number, each used once.

    The n-th point of a number meets the n-th photo of that number; ``keys``
    (folder or flight) restrict the match.
    """
    from fieldspark.operators.relate import match_by_rank

    seq = F.regexp_extract(file, r"(?i)_(\d{4})(?:_[A-Z])?\.JPG$", 1)
    a = photos.withColumn("_seq", F.when(seq != "", seq.cast("int")))
    wanted = {"foto": "Foto", "lat": "Lat", "lon": "Lon", "alt": "Alt", "mrk_file": "MrkFile", "mrk_path": "MrkPath",
              "folder": "MrkFolder", "date_name": "DateName", "flight_number": "_fn", "flight_name": "_fname"}
    cols = [F.col(o).alias(n) for o, n in wanted.items() if o in mrk.columns]
    b = mrk.select(F.col("foto").cast("int").alias("_seq"), *keys, *cols)
    b = b.withColumn("_ord", F.struct("MrkPath" if "MrkPath" in b.columns else "Foto", "Foto", "Lat", "Lon"))
    known = a.filter(F.col("_seq").isNotNull())
    rest = a.filter(F.col("_seq").isNull()).drop("_seq")
    drop = [c for c in ("Foto", "Lat", "Lon", "Alt", "MrkFile", "MrkPath", "MrkFolder", "DateName") if c in a.columns and c in b.columns]
    out = match_by_rank(known.drop(*drop), b, [*keys, "_seq"], file, "_ord")
    hit = F.col("Foto").isNotNull()
    fills = {"CoordSource": F.when(hit, "MRK"), "QualityFlag": F.when(hit, "OK")}
    for name, col in (("CoordSource", "MRK"), ("QualityFlag", "OK")):
        if has(photos, name):
            fills[name] = F.when(hit, col).otherwise(F.col(name))
    for name, col in (("FlightNumber", "_fn"), ("FlightName", "_fname")):
        if col in out.columns:
            fills[name] = F.coalesce(F.col(col).cast("string"), raw(out, name))
    out = out.withColumns(fills).drop("_seq", "_ord", "_fn", "_fname")
    return out.unionByName(rest, allowMissingColumns=True)
