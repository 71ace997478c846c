"""Report side of photo records: indicators, scores, sequence values and aggregates."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.catalog import (
    DERIVED_LABELS,
    EXCLUDED_WORDS,
    IGNORED_LABELS,
    LIGHT_LABELS_PT,
    camera_of,
    light_label,
    literal_map,
)
from fieldspark.functions.rules import THRESHOLDS, level_of, message_of
from fieldspark.functions.text import (
    REPORT_FORMATS,
    duration_text,
    finite_num,
    is_missing,
    is_zero,
    parse_ts,
    present,
    shutter_text,
    stage_text,
)
from fieldspark.operators.photos import finite_field, flight_id, has, num, raw
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence
from fieldspark.plans.quantiles import order_statistics
from fieldspark.plans.sizing import cut_lineage

# Fixed values of the report side.
LIGHT_NAMES = {
    1: "Daylight",
    2: "Fluorescent",
    3: "Tungsten",
    4: "Flash",
    9: "Fine Weather",
    10: "Cloudy Weather",
    11: "Shade",
}
SLOPE_CLASSES = (
    (0, 1, "Plano"),
    (1, 3, "Leve Inclinacao"),
    (3, 5, "Inclinado"),
    (5, 10, "Moderadamente Inclinado"),
    (10, 15, "Inclinacao Acentuada"),
    (15, 25, "Relevo Acidentado"),
    (25, 99, "Nao Mecanizavel"),
)
STAGES = (
    ("initial", "Varredura"),
    ("mrk", "MRK"),
    ("exif", "EXIF"),
    ("xmp", "XMP"),
    ("custom", "Custom"),
    ("vectorization", "Vetorizacao"),
    ("report", "Relatorio"),
)
UNAVAILABLE = "Indisponivel"


def r4(c: Column) -> Column:
    return F.bround(c, 4)


def _n(df: DataFrame, *names: str) -> Column:
    return num(df, *names, default=None)


def _text(df: DataFrame, *names: str) -> Column:
    found = [present(F.col(f"`{n}`").cast("string")) for n in names if has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _wrapped(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360.0 - d).otherwise(d)


def derived_values(df: DataFrame) -> dict[str, Column]:
    """Fallback formulas of the report; null where an input is missing."""
    cam = camera_of(raw(df, "Model"))
    sw, sh = cam.w, cam.h
    focal = _n(df, "FocalLength")
    focal = F.when(focal > 0, focal)
    width = _n(df, "ExifImageWidth")
    width = F.when(width > 0, width)
    pitch, gyaw, fyaw = _n(df, "GimbalPitchDegree"), _n(df, "GimbalYawDegree"), _n(df, "FlightYawDegree")
    exposure, fnum = _n(df, "ExposureTime"), _n(df, "FNumber")
    speed = F.coalesce(_n(df, "3DSpeed"), _n(df, "Speed3dKmh") / 3.6)
    incidence = F.coalesce(_n(df, "IncidenceAngle"), F.abs(pitch))
    lrf, rel, absolute = _n(df, "LRFTargetDistance"), _n(df, "RelativeAltitude"), _n(df, "AbsoluteAltitude")
    alt = _n(df, "Alt")
    fly = F.when((lrf > 0) & incidence.isNotNull(), r4(lrf * F.cos(F.radians(incidence)))).otherwise(rel)
    cover_w, cover_h = r4(fly * sw / focal), r4(fly * sh / focal)
    overlap = F.when(
        cover_w > 0,
        r4(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1.0 - _n(df, "Distance3dPrevious") / cover_w) * 100.0))),
    )
    overlap = F.when(_n(df, "Distance3dPrevious").isNotNull(), overlap)
    stds = [_n(df, n) for n in ("RtkStdLat", "RtkStdLon", "RtkStdHgt")]
    count = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in stds), F.lit(0))
    rtk = F.when(count > 0, r4(sum((F.coalesce(s, F.lit(0.0)) for s in stds), F.lit(0.0)) / count))
    age, flag = _n(df, "RtkDiffAge"), _n(df, "RtkFlag")
    ev = F.when(exposure > 0, r4(F.log2(fnum * fnum / exposure)))
    iso = _n(df, "ISOSpeedRatings")
    code = _n(df, "LightSource").cast("int")
    light = F.coalesce(
        F.trim(_text(df, "LightSourceClassification")),
        F.try_element_at(literal_map(LIGHT_NAMES, "int", "string"), code),
    )
    ev_used = F.coalesce(_n(df, "ExposureValueEv"), ev)
    ev_class = (
        F.when(ev_used < 6, "noite/escuro")
        .when(ev_used < 10, "indoor/sombra")
        .when(ev_used < 12, "nublado")
        .when(ev_used < 15, "luz solar normal")
        .when(ev_used.isNotNull(), "sol muito forte/neve")
        .when(light == "Daylight", "luz solar normal")
        .when(light == "Fluorescent", "indoor/sombra")
        .when(light == "Cloudy Weather", "nublado")
    )
    diag = F.hypot(sw, sh)
    coc = F.bround(diag / 1730.0, 6)
    hyper = focal * focal / (F.when(fnum > 0, fnum) * coc)
    focus = _n(df, "FocusDistance")
    dof = F.when(
        hyper > focal,
        2.0 * hyper * focus * (focus - focal) / (hyper * hyper - (focus - focal) * (focus - focal)),
    )
    sensor, lens = _n(df, "SensorTemperature"), _n(df, "LensTemperature")
    heat = F.when(sensor.isNotNull() & lens.isNotNull(), (sensor + lens) / 2).otherwise(F.coalesce(sensor, lens))
    return {
        "speed_3d_ms": speed,
        "speed_3d_kmh": speed * 3.6,
        "incidence_angle": incidence,
        "sensor_temp_c": F.coalesce(sensor, lens),
        "gsd_cm": r4(sw * F.coalesce(rel, _n(df, "FlightAltitude"), alt) * 100.0 / (focal * width)),
        "motion_blur_risk": r4(speed * exposure / (sw / width)),
        "gimbal_offset": r4(_wrapped(gyaw - fyaw, F.lit(180.0))),
        "yaw_alignment_error": r4(_wrapped(gyaw, fyaw)),
        "yaw_relative_error": r4(F.pmod(gyaw - fyaw, F.lit(360.0))),
        "rtk_effective_precision": rtk,
        "rtk_type": F.when(flag == 0, "Sem GPS")
        .when(flag == 16, "RTK Single")
        .when(flag == 34, "RTK Float")
        .when(flag == 50, "RTK Fixed")
        .when(flag.isNotNull(), "RTK Desconhecido"),
        "rtk_stability_score": F.when(age <= 0.5, 100.0)
        .when(age <= 1.0, 99.0)
        .when(age <= 2.0, 98.0)
        .when(age <= 5.0, 95.0)
        .when(age.isNotNull(), 90.0),
        "xy_difference": r4(
            geo.haversine(_n(df, "Lat"), _n(df, "Lon"), _n(df, "GpsLatitudeXmp"), _n(df, "GpsLongitudeXmp"))
        ),
        "z_difference": r4(F.abs(alt - absolute)),
        "ground_elevation": r4(absolute - rel),
        "flight_altitude": fly,
        "coverage_width": cover_w,
        "coverage_height": cover_h,
        "predicted_overlap": overlap,
        "is_ideal_overlap": overlap >= 60.0,
        "light_source_classification": light,
        "light_consistency": light,
        "exposure_value_ev": ev,
        "light_value": F.when(iso > 0, r4(ev + F.log2(iso / 100.0))),
        "ev_classification": ev_class,
        "focal_length_35efl": r4(_n(df, "FocalLength") * 36.0 / sw),
        "fov": r4(2.0 * F.degrees(F.atan(diag / (2.0 * focal)))),
        "circle_of_confusion": coc,
        "hyperfocal_distance": r4(hyper / 1000.0),
        "dof": F.when(dof > 0, r4(dof / 1000.0)),
        "nadir": F.when(F.abs(F.abs(pitch) - 90.0) <= 3.0, "Nadir").when(pitch.isNotNull(), "Obliqua"),
        "total_heat_index": r4(heat),
        "shutter_life_pct": r4(_n(df, "ShutterCount") / 200000.0 * 100.0),
        "orthorectification_potential": r4(F.greatest(F.lit(0.0), 100.0 - incidence)),
    }


# Derived value -> record field it stands in for when the record has none.
FALLBACK_FIELDS = {
    "3DSpeed": "speed_3d_ms",
    "Speed3dKmh": "speed_3d_kmh",
    "MotionBlurRisk": "motion_blur_risk",
    "GimbalOffset": "gimbal_offset",
    "YawAlignmentError": "yaw_alignment_error",
    "YawRelativeError": "yaw_relative_error",
    "RtkEffectivePrecision": "rtk_effective_precision",
    "RtkType": "rtk_type",
    "RtkStabilityScore": "rtk_stability_score",
    "XYDifference": "xy_difference",
    "ZDifference": "z_difference",
    "GroundElevation": "ground_elevation",
    "FlightAltitude": "flight_altitude",
    "CoverageWidth": "coverage_width",
    "CoverageHeight": "coverage_height",
    "PredictedOverlap": "predicted_overlap",
    "FOverlap": "predicted_overlap",
    "IsIdealOverlap": "is_ideal_overlap",
    "LightSourceClassification": "light_source_classification",
    "LightConsistency": "light_consistency",
    "ExposureValueEv": "exposure_value_ev",
    "LightValue": "light_value",
    "EvClassification": "ev_classification",
    "FocalLength35efl": "focal_length_35efl",
    "FOV": "fov",
    "CircleOfConfusion": "circle_of_confusion",
    "HyperfocalDistance": "hyperfocal_distance",
    "DOF": "dof",
    "Nadir": "nadir",
    "TotalHeatIndex": "total_heat_index",
    "ShutterLifePct": "shutter_life_pct",
    "OrthorectificationPotential": "orthorectification_potential",
    "LinearVelocityInstant": "speed_3d_ms",
}
# Indicators read straight from the record.
RECORD_INDICATORS = {
    "rtk_std_lon": "RtkStdLon",
    "rtk_std_lat": "RtkStdLat",
    "rtk_std_hgt": "RtkStdHgt",
    "vertical_stability": "VerticalStability",
    "speed_variation_index": "SpeedVariationIndex",
    "gimbal_angular_velocity": "GimbalAngularVelocity",
    "trajectory_smoothness": "TrajectorySmoothness",
    "capture_efficiency": "CaptureEfficiency",
    "is_valid_sequence_prev": "is_valid_sequence_prev",
    "is_valid_sequence_next": "is_valid_sequence_next",
    "abrupt_change_flag": "AbruptChangeFlag",
    "rtk_diff_age": "RtkDiffAge",
    "dewarp_flag": "DewarpFlag",
}


def report_indicators(df: DataFrame) -> DataFrame:
    """Add ``i_<name>`` for every derived value and fill record fields that are absent."""
    values = derived_values(df)
    out = df.withColumns({f"i_{k}": v for k, v in values.items()})
    fills = {}
    for field, key in FALLBACK_FIELDS.items():
        derived = F.col(f"i_{key}")
        if has(df, field):
            kind = dict(df.dtypes)[field]
            if kind == "string":
                fills[field] = F.coalesce(present(F.col(f"`{field}`")), derived.cast("string"))
            else:
                fills[field] = F.coalesce(F.col(f"`{field}`"), derived.cast(kind))
        else:
            fills[field] = derived
    return out.withColumns(fills)


def _indicator_value(df: DataFrame, name: str) -> Column | None:
    """Text of a threshold indicator, None where the record cannot have it."""
    if name == "photogrammetry_quality_index":
        return None
    if name in RECORD_INDICATORS:
        field = RECORD_INDICATORS[name]
        return present(F.col(f"`{field}`").cast("string")) if has(df, field) else None
    return F.col(f"i_{name}").cast("string")


def score_images(df: DataFrame, rules: dict = THRESHOLDS, file: str = "File") -> DataFrame:
    """Level and message of every indicator a photo has, and the mean level as its score.

    ``scored`` is an array of (indicator, value, level, message).  Everything is
    a projection of the photo's own row, so nothing is shuffled.
    """
    d = report_indicators(df)
    parts, total, count = [], F.lit(0), F.lit(0)
    levels, kinds = {}, dict(d.dtypes)
    for name, rule in rules.items():
        value = _indicator_value(d, name)
        if value is None:
            continue
        source = RECORD_INDICATORS.get(name, f"i_{name}")
        typed = kinds.get(source) == "double" and rule["type"] != "categorical"
        levels[name] = (value, level_of(rule, F.col(f"`{source}`") if typed else value, typed))
    d = d.withColumns({f"l_{n}": lvl for n, (_, lvl) in levels.items()})
    for name, (value, _) in levels.items():
        lvl = F.col(f"l_{name}")
        total = total + F.coalesce(lvl, F.lit(0))
        count = count + F.when(lvl.isNotNull(), 1).otherwise(0)
        parts.append(
            F.when(
                lvl.isNotNull(),
                F.struct(
                    F.lit(name).alias("indicator"),
                    value.alias("value"),
                    lvl.alias("level"),
                    message_of(rules[name], lvl).alias("message"),
                ),
            )
        )
    unknown = F.lit("unknown")
    return d.withColumns(
        {
            "filename": F.coalesce(_text(d, file), unknown),
            "flight_id": flight_id(d, "mrk"),
            "overall_score": F.when(count > 0, F.bround(total / count, 1)).otherwise(0.0),
            "capture_ts": parse_ts(_text(d, "DateTimeOriginal", "UTCAtExposure"), REPORT_FORMATS),
            "equipment_model": F.coalesce(_text(d, "DroneModel", "Model"), unknown),
            "equipment_serial": F.coalesce(_text(d, "DroneSerialNumber"), unknown),
            "camera_model": F.coalesce(_text(d, "Model"), unknown),
            "camera_serial": F.coalesce(_text(d, "CameraSerialNumber"), unknown),
            "scored": F.array_compact(F.array(*parts)),
        }
    ).drop(*[f"l_{n}" for n in levels])


def scored_long(scored: DataFrame) -> DataFrame:
    """One row per photo and indicator.

    The outer form keeps Spark from deriving a size filter on ``scored`` and
    substituting its whole expression below the projections.
    """
    rows = scored.select("filename", "flight_id", F.inline_outer("scored"))
    return rows.filter(F.col("indicator").isNotNull())


def sequence_indicators(
    scored: DataFrame, partition_by: Seq[str] | None = None, cut: bool | None = None
) -> DataFrame:
    """Values against the photo before in capture order, over all photos or per partition.

    Photos without a time come first.  Fields are null where an input is missing.
    """
    group = list(partition_by or [])
    d = scored.withColumns(
        {
            "_t": F.unix_micros("capture_ts") / 1e6,
            "_ord": F.coalesce(F.unix_micros("capture_ts"), F.lit(-(2**62))),
            "_lat": _n(scored, "Lat"),
            "_lon": _n(scored, "Lon"),
            "_alt": _n(scored, "Alt", "AbsoluteAltitude"),
            "_rel": _n(scored, "RelativeAltitude"),
            "_gy": _n(scored, "GimbalYawDegree"),
            "_fy": _n(scored, "FlightYawDegree"),
            "_v": F.col("i_speed_3d_ms"),
        }
    )
    names = ["_t", "_lat", "_lon", "_alt", "_rel", "_gy", "_fy", "_v"]

    def steps(x: DataFrame, w) -> DataFrame:
        lag = {f"_p{n}": F.lag(n).over(w) for n in names}
        return x.withColumns(lag | {"_nt": F.lead("_t").over(w)})

    seq = Sequence(d, group, ["_ord", "filename"], cut=cut).bounded(1, steps)
    c = {n: F.col(n) for n in names}
    p = {n: F.col(f"_p{n}") for n in names}
    x = seq.df.withColumns(
        {
            "_dt": c["_t"] - p["_t"],
            "_d": geo.haversine(c["_lat"], c["_lon"], p["_lat"], p["_lon"]),
            "_turn": _wrapped(c["_fy"], p["_fy"]),
        }
    )
    dt, dist = F.col("_dt"), F.col("_d")
    moving = dt > 0
    x = x.withColumns(
        {
            "time_since_previous": r4(dt),
            "geodesic_distance_previous": r4(dist),
            "distance_3d_previous": r4(F.hypot(dist, c["_alt"] - p["_alt"])),
            "avg_velocity_between_photos": F.when(moving, r4(dist / dt)),
            "displacement_direction": F.when(
                dist > 0, r4(geo.bearing(c["_lat"], c["_lon"], p["_lat"], p["_lon"]))
            ),
            "gimbal_angular_velocity": F.when(moving, r4(F.abs(c["_gy"] - p["_gy"]) / dt)),
            "vertical_stability": r4(F.abs(c["_rel"] - p["_rel"])),
            "trajectory_smoothness": r4(F.col("_turn")),
            "speed_variation_index": F.when(p["_v"] > 0, r4(F.abs(c["_v"] - p["_v"]) / p["_v"])),
            "capture_efficiency": F.when(
                F.col("i_coverage_width") > 0, r4(r4(dist) / F.col("i_coverage_width"))
            ),
            "abrupt_change_flag": F.when(
                dt.isNotNull() & dist.isNotNull(), (dt > 10.0) | (r4(dist) > 100.0)
            ),
            "is_valid_sequence_prev": F.when((dt > 0) & (dt <= 10), 1).otherwise(0),
            "is_valid_sequence_next": F.when(
                (F.col("_nt") - c["_t"] > 0) & (F.col("_nt") - c["_t"] <= 10), 1
            ).when(F.col("_nt").isNotNull() & c["_t"].isNotNull(), 0),
        }
    )
    seq.df = x
    seq.running(strip_id=F.when(F.col("_turn") > 45.0, 1).otherwise(0))
    out = seq.result().withColumn("strip_id", F.col("strip_id") + 1)
    return out.drop(*names, *[f"_p{n}" for n in names], "_ord", "_nt", "_dt", "_d", "_turn")


def _mean2(value: Column, digits: int = 2) -> Column:
    return F.bround(F.avg(value), digits)


def indicator_statistics(scored: DataFrame, rules: dict = THRESHOLDS, cut: bool | None = None) -> DataFrame:
    """Level and value statistics per indicator; a photo without it counts as level 3.

    Scoring is costly, so the photos are read once: equal (indicator, value, level) are counted and written down, and
    all else is worked out from the counts.
    """
    total = scored.agg(F.count(F.lit(1)).alias("_all"))
    long = scored_long(scored).select("indicator", "level", finite_num(F.col("value")).alias("_x"))
    counted = cut_lineage(long.groupBy("indicator", "level", "_x").agg(F.count(F.lit(1)).alias("_m")))
    m, lvl, x = F.col("_m"), F.col("level"), F.col("_x")
    base = counted.groupBy("indicator").agg(
        F.sum(m).alias("_n"),
        F.sum(lvl * m).alias("_s"),
        F.sum(lvl * lvl * m).alias("_s2"),
        *[F.sum(F.when(lvl == k, m).otherwise(0)).alias(f"level_{k}") for k in range(1, 6)],
        F.sum(F.when(x.isNotNull(), m).otherwise(0)).alias("_vn"),
        F.sum(x * m).alias("_vs"),
        F.min(x).alias("_min"),
        F.max(x).alias("_max"),
    ).withColumn("_mean", F.col("_vs") / F.nullif(F.col("_vn"), F.lit(0)))
    # One row per indicator.
    away = x - F.col("_mean")
    spread = join_on(counted, base.select("indicator", "_mean"), ["indicator"], small=True)
    spread = spread.groupBy("indicator").agg(F.sum(away * away * m).alias("_away"))
    vn = F.col("_vn")
    base = join_on(base, spread, ["indicator"]).withColumns(
        {
            "value_mean": r4(F.col("_mean")),
            "value_std": F.when(vn > 1, r4(F.sqrt(F.col("_away") / (vn - 1)))).when(vn == 1, 0.0),
            "value_min": r4(F.col("_min")),
            "value_max": r4(F.col("_max")),
            "value_range": r4(F.col("_max") - F.col("_min")),
        }
    )
    pct = order_statistics(
        counted, ["indicator"], "_x", {"_p5": 0.05, "_p95": 0.95}, "floor", cut=cut, times="_m"
    )
    d = join_on(base.crossJoin(F.broadcast(total)), pct, ["indicator"], "left")  # total is one row
    missing = F.col("_all") - F.col("_n")
    s, s2, n = F.col("_s") + 3 * missing, F.col("_s2") + 9 * missing, F.col("_all")
    var = F.when(n > 1, F.greatest((s2 - s * s / n) / (n - 1), F.lit(0.0))).otherwise(0.0)
    return d.select(
        "indicator",
        F.bround(s / n, 2).alias("mean"),
        F.bround(F.sqrt(var), 2).alias("std"),
        "value_mean",
        "value_std",
        r4(F.col("_p5")).alias("value_p5"),
        r4(F.col("_p95")).alias("value_p95"),
        "value_min",
        "value_max",
        "value_range",
        r4(F.col("_p95") - F.col("_p5")).alias("value_percentile_range"),
        *[(F.col(f"level_{k}") + (missing if k == 3 else 0)).alias(f"level_{k}") for k in range(1, 6)],
    )


def level_distribution(stats: DataFrame) -> DataFrame:
    """Photos per level over all indicators."""
    cols = [f"level_{k}" for k in range(1, 6)]
    return stats.agg(*[F.sum(c).alias(c) for c in cols])


def pqi_summary(scored: DataFrame, rules: dict = THRESHOLDS) -> DataFrame:
    """Mean quality index, its level (cuts passed plus one) and photos per level."""
    cuts = [float(c) for c in rules["photogrammetry_quality_index"]["levels"]]
    texts = rules["photogrammetry_quality_index"]["messages"]

    def level(v: Column) -> Column:
        passed = sum((F.when(v >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        return F.greatest(F.lit(1), F.least(F.lit(5), passed + 1))

    v = finite_field(scored, "PhotogrammetryQualityIndex")
    d = scored.select(v.alias("v")).withColumn("l", F.when(F.col("v").isNotNull(), level(F.col("v"))))
    one = d.agg(
        F.avg("v").alias("pqi_mean"),
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("l") == k).alias(f"level_{k}") for k in range(1, 6)],
    )
    none = F.col("pqi_mean").isNull()
    one = one.withColumn("level_3", F.when(none, F.col("_all")).otherwise(F.col("level_3")))
    one = one.withColumn("pqi_level", F.when(~none, level(F.col("pqi_mean"))))
    labels = F.array(*[F.lit(t) for t in texts])
    return one.select(
        F.bround("pqi_mean", 2).alias("pqi_mean"),
        "pqi_level",
        F.try_element_at(labels, F.col("pqi_level")).alias("pqi_label"),
        *[f"level_{k}" for k in range(1, 6)],
    )


def candidate_fields(df: DataFrame) -> list[str]:
    """Derived fields a flight table may average, sorted by label."""
    out = []
    for key, label in DERIVED_LABELS.items():
        words = f"{key} {label}".lower()
        if label in IGNORED_LABELS or any(w in words for w in EXCLUDED_WORDS) or not has(df, key):
            continue
        out.append(key)
    return sorted(out, key=lambda k: DERIVED_LABELS[k].lower())


def numeric_fields(df: DataFrame) -> list[str]:
    """Candidate fields with at least one finite number, found in one pass."""
    names = candidate_fields(df)
    if not names:
        return []
    one = df.agg(*[F.max(finite_num(F.col(f"`{n}`")).isNotNull()).alias(f"c{i}") for i, n in enumerate(names)])
    row = one.first()
    return [n for n, found in zip(names, row) if found]


def aggregate_flights(scored: DataFrame) -> DataFrame:
    """One row per flight: counts, times, means, estimated area and a map of field means."""
    d = scored

    def v(*names: str) -> Column:
        return finite_field(d, *names)

    speed = v("Speed3dKmh")
    lrf, exposure = v("LRFTargetDistance"), v("ExposureTime")
    iw, ih = v("ExifImageWidth"), v("ExifImageHeight")
    sized = (iw > 0) & (ih > 0)
    fields = candidate_fields(d)
    means = [F.bround(F.avg(finite_field(d, n)), 2).alias(f"_m{i}") for i, n in enumerate(fields)]
    g = d.groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("images"),
        _mean2(F.col("overall_score")).alias("mean_score"),
        F.min("capture_ts").alias("start"),
        F.max("capture_ts").alias("end"),
        F.avg(speed).alias("_kmh"),
        _mean2(v("SensorTemperature", "LensTemperature")).alias("avg_sensor_temperature"),
        _mean2(F.when(lrf > 0, lrf)).alias("avg_lrf_target_distance"),
        F.avg(v("RelativeAltitude")).alias("_rel"),
        F.avg(v("AbsoluteAltitude")).alias("_abs"),
        _mean2(v("ISOSpeedRatings", "RecommendedExposureIndex")).alias("avg_iso"),
        _mean2(v("WhiteBalanceCCT")).alias("avg_white_balance_cct"),
        F.avg(F.when(exposure > 0, exposure)).alias("_exp"),
        F.min(F.when(exposure > 0, exposure)).alias("_exp_min"),
        F.max(F.when(exposure > 0, exposure)).alias("_exp_max"),
        _mean2(F.abs(v("Distance3dPrevious"))).alias("avg_dist3d_previous"),
        _mean2(F.abs(v("FlightRollDegree"))).alias("avg_flight_roll"),
        _mean2(F.abs(v("FlightYawDegree"))).alias("avg_flight_yaw"),
        _mean2(F.abs(v("FlightPitchDegree"))).alias("avg_flight_pitch"),
        F.avg(F.when(sized, iw)).alias("_iw"),
        F.avg(F.when(sized, ih)).alias("_ih"),
        *means,
    )
    pairs = [F.struct(F.lit(n).alias("key"), F.col(f"_m{i}").alias("value")) for i, n in enumerate(fields)]
    g = g.withColumn(
        "field_means", F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.value.isNotNull()))
    )
    gsd = F.try_element_at("field_means", F.lit("GroundSampleDistanceCm"))
    overlap = F.try_element_at("field_means", F.lit("FOverlap"))
    seconds = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 1e6)
    return g.select(
        "flight_id",
        "images",
        "mean_score",
        "start",
        "end",
        seconds.alias("flight_seconds"),
        duration_text(seconds).alias("flight_time"),
        F.bround("_kmh", 2).alias("avg_speed3d_kmh"),
        F.bround(F.col("_kmh") / 3.6, 2).alias("avg_speed3d_ms"),
        "avg_sensor_temperature",
        "avg_lrf_target_distance",
        F.bround("_rel", 2).alias("avg_relative_altitude"),
        F.bround("_abs", 2).alias("avg_absolute_altitude"),
        F.bround(F.col("_abs") - F.col("_rel"), 2).alias("altitude_solo"),
        "avg_iso",
        "avg_white_balance_cct",
        shutter_text(F.col("_exp")).alias("avg_shutter_speed_text"),
        F.coalesce(
            F.concat(
                F.lit("entre "),
                F.when(F.col("_exp_max").isNotNull(), shutter_text(F.col("_exp_max"))),
                F.lit(" e "),
                shutter_text(F.col("_exp_min")),
            ),
            F.lit("N/A"),
        ).alias("shutter_speed_range_text"),
        "avg_dist3d_previous",
        "avg_flight_roll",
        "avg_flight_yaw",
        "avg_flight_pitch",
        F.bround(estimated_area(gsd, overlap, F.col("_iw"), F.col("_ih"), F.col("images")), 2).alias(
            "estimated_area_ha"
        ),
        "field_means",
    )


def estimated_area(gsd_cm: Column, overlap: Column, width: Column, height: Column, n: Column) -> Column:
    """Hectares covered by n photos of a pixel size and mutual overlap."""
    m, keep = gsd_cm / 100.0, 1.0 - overlap / 100.0
    return F.when(gsd_cm > 0, width * m * height * m * keep * keep * n / 10000.0)


def total_area(flights: DataFrame) -> DataFrame:
    return flights.agg(F.bround(F.sum("estimated_area_ha"), 2).alias("total_area_ha"))


def general_info(scored: DataFrame) -> DataFrame:
    """Distinct models, serials, firmware, datum and status, one row per (kind, value).

    Also the capture start and end as rows of kind ``capture_start``/``capture_end``.
    """
    d = scored

    def known(c: Column, *bad: str) -> Column:
        t = F.trim(c)
        return F.when(t.isNotNull() & (t != "") & ~F.lower(t).isin(*bad), t)

    kinds = {
        "equipment_models": known(F.col("equipment_model"), "unknown"),
        "equipment_serial_numbers": known(F.col("equipment_serial"), "unknown"),
        "camera_models": known(F.col("camera_model"), "unknown"),
        "camera_serial_numbers": known(F.col("camera_serial"), "unknown"),
        "firmware_versions": known(raw(d, "Software", "Firmware"), "unknown", "none", "null"),
        "gps_datum": known(raw(d, "GPSMapDatum"), "none", "null"),
        "gps_status": known(raw(d, "GpsStatusExif"), "none", "null"),
        "gps_status_xmp": known(raw(d, "GpsStatusXmp"), "none", "null"),
    }
    wide = d.select(*[c.alias(n) for n, c in kinds.items()])
    values = wide.unpivot([], list(kinds), "kind", "value").filter(F.col("value").isNotNull()).distinct()
    layout = "yyyy-MM-dd HH:mm:ss"
    span = d.agg(
        F.coalesce(F.date_format(F.min("capture_ts"), layout), F.lit("N/A")).alias("capture_start"),
        F.coalesce(F.date_format(F.max("capture_ts"), layout), F.lit("N/A")).alias("capture_end"),
    ).unpivot([], ["capture_start", "capture_end"], "kind", "value")
    return values.unionByName(span)


def by_prefix(scored: DataFrame) -> DataFrame:
    """Photos and mean score per file-name prefix."""
    f = F.col("filename")
    model = F.when(f.contains("_"), F.split_part(f, F.lit("_"), F.lit(1))).otherwise("unknown")
    return scored.groupBy(model.alias("model")).agg(
        F.count(F.lit(1)).alias("count"), _mean2(F.col("overall_score")).alias("mean_score")
    )


def last_shutter(scored: DataFrame) -> DataFrame:
    """Shutter count of each camera's latest photo; the highest count without times."""
    d = scored.withColumn("_sc", _n(scored, "ShutterCount")).filter(F.col("_sc").isNotNull())
    row = F.struct(F.col("_sc"), F.col("flight_id"), F.col("filename"))
    g = d.groupBy(F.col("camera_serial")).agg(
        F.max_by(row, F.when(F.col("capture_ts").isNotNull(), F.struct("capture_ts", "filename"))).alias("_t"),
        F.max_by(row, F.struct("_sc", "filename")).alias("_m"),
    )
    r = F.coalesce("_t", "_m")
    return g.select("camera_serial", r["_sc"].alias("last_shutter_count"), r["flight_id"].alias("flight_id"), r["filename"].alias("file"))


def light_distribution(scored: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Photos and share per light source: the text label, else the label of the code.

    ``records`` is the table before fallbacks were filled in, so a label computed
    from the code still counts as coming from the code.
    """
    d = records if records is not None else scored
    text = F.trim(_text(d, "LightSourceClassification"))
    code = _n(d, "LightSource")
    origin = F.when(text.isNotNull(), "text").when(code.isNotNull(), "code")
    label = F.coalesce(text, F.when(code.isNotNull(), light_label(code)))
    g = (
        d.select(label.alias("label_raw"), origin.alias("o"))
        .filter(F.col("label_raw").isNotNull())
        .groupBy("label_raw")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(F.col("o") == "text").alias("from_text"),
            F.count_if(F.col("o") == "code").alias("from_code"),
        )
    )
    total = g.agg(F.sum("count").alias("_t"))
    best = g.agg(F.min(F.struct(-F.col("count"), F.lower("label_raw"), F.col("label_raw"))).alias("_b"))
    names = literal_map(LIGHT_LABELS_PT, "string", "string")
    d = g.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(best))  # one row each
    return d.select(
        "label_raw",
        F.coalesce(F.try_element_at(names, F.col("label_raw")), F.col("label_raw")).alias("label_pt"),
        "count",
        F.bround(F.col("count") * 100.0 / F.col("_t"), 2).alias("pct"),
        "from_text",
        "from_code",
        (F.col("label_raw") == F.col("_b.label_raw")).alias("predominant"),
    )


SERIES = {
    "rtk_diff_age": ("RtkDiffAge",),
    "ground_elevation": ("GroundElevation",),
    "gimbal_offset": ("GimbalOffset",),
    "overlap": ("PredictedOverlap", "FOverlap"),
    "speed_ms": ("3DSpeed",),
    "relative_altitude": ("RelativeAltitude",),
    "lrf_target": ("LRFTargetDistance",),
    "dist3d_prev": ("Distance3dPrevious",),
    "flight_roll": ("FlightRollDegree",),
    "flight_yaw": ("FlightYawDegree",),
    "flight_pitch": ("FlightPitchDegree",),
    "motion_blur": ("MotionBlurRisk",),
}


def series_values(scored: DataFrame) -> DataFrame:
    """The twelve report series as a long (series, value) table."""
    cols = {}
    for name, fields in SERIES.items():
        v = F.coalesce(*[finite_field(scored, f) for f in fields])
        cols[name] = F.when(v > 0, v) if name == "lrf_target" else v
    d = scored.select(*[c.alias(n) for n, c in cols.items()])
    return d.unpivot([], list(cols), "series", "value").filter(F.col("value").isNotNull())


def advanced_metrics(scored: DataFrame, cut: bool | None = None) -> DataFrame:
    """One row: mean, p5, p95 and range of the series plus shares and spreads."""
    from fieldspark.operators.stats import percentile_stats

    per = percentile_stats(series_values(scored), "value", ["series"], cut=cut)
    # Twelve rows at most, turned into one.
    wide = per.agg(
        *[
            F.max(F.when(F.col("series") == s, F.col(k))).alias(f"{s}_{k}")
            for s in SERIES
            for k in ("mean", "p5", "p95", "range")
        ]
    )
    overlap = F.coalesce(*[finite_field(scored, f) for f in SERIES["overlap"]])
    yaw, gimbal = finite_field(scored, "YawAlignmentError"), finite_field(scored, "GimbalOffset")
    size, speed_var = finite_field(scored, "SizeMb"), finite_field(scored, "SpeedVariationIndex")
    rtk, light = raw(scored, "RtkEffectivePrecision"), F.trim(raw(scored, "LightConsistency"))
    rtk_num = finite_num(rtk)

    def share(cond: Column, of: Column) -> Column:
        return F.bround(F.count_if(cond) * 100.0 / F.nullif(F.count(of), F.lit(0)), 2)

    def spread(v: Column) -> Column:
        return F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0)

    rest = scored.agg(
        share(overlap < 60.0, overlap).alias("overlap_below_ideal_pct"),
        share(yaw >= 150.0, yaw).alias("yaw_inconsistent_pct"),
        r4(spread(gimbal)).alias("gimbal_offset_std"),
        r4(F.max(gimbal)).alias("gimbal_offset_max"),
        share(F.abs(gimbal) > 1.0, gimbal).alias("gimbal_offset_over_1deg_pct"),
        r4(F.avg(size)).alias("size_mb_mean"),
        r4(spread(size)).alias("size_mb_std"),
        r4(F.when(F.avg(size) != 0, spread(size) / F.avg(size)).otherwise(F.when(F.count(size) > 0, 0.0))).alias("size_mb_cv"),
        r4(F.avg(speed_var)).alias("speed_variation_mean"),
        r4(F.avg(rtk_num)).alias("rtk_effective_precision_mean"),
        r4(F.max(rtk_num)).alias("rtk_effective_precision_max"),
        F.array_join(F.array_sort(F.collect_set(F.when(rtk_num.isNull() & ~is_missing(rtk), F.trim(rtk)))), ", ").alias(
            "rtk_effective_precision_raw"
        ),
        F.coalesce(share(F.lower(light) == "inconsistent", light), F.lit(0.0)).alias("light_inconsistent_pct"),
    )
    return wide.crossJoin(rest)  # one row each


def rtk_class(scored: DataFrame) -> DataFrame:
    v = finite_field(scored, "RtkStabilityScore")
    one = scored.agg(F.avg(v).alias("m"))
    label = (
        F.when(F.col("m") >= 95, "Estavel").when(F.col("m") >= 85, "Moderado").when(F.col("m").isNotNull(), "Instavel")
    )
    return one.select(
        r4(F.col("m")).alias("rtk_stability_mean"), F.coalesce(label, F.lit(UNAVAILABLE)).alias("rtk_stability_class")
    )


def quality_trend(scored: DataFrame, cut: bool | None = None) -> DataFrame:
    """Quality index of the first and last quarter in time, of mornings and middays."""
    v = finite_field(scored, "PhotogrammetryQualityIndex")
    d = scored.select("capture_ts", "filename", v.alias("v")).filter(
        F.col("capture_ts").isNotNull() & F.col("v").isNotNull()
    )
    ranked = Sequence(d, [], ["capture_ts", "filename"], cut=cut).number("_rn").result()
    total = d.agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    quarter = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    hour = F.hour("capture_ts")
    one = ranked.agg(
        F.avg(F.when(F.col("_rn") <= quarter, F.col("v"))).alias("f"),
        F.avg(F.when(F.col("_rn") > F.col("_n") - quarter, F.col("v"))).alias("l"),
        F.avg(F.when(hour < 11, F.col("v"))).alias("m"),
        F.avg(F.when((hour >= 11) & (hour < 15), F.col("v"))).alias("d"),
    )
    return one.select(
        F.bround("f", 2).alias("pqi_first_quartile_mean"),
        F.bround("l", 2).alias("pqi_last_quartile_mean"),
        F.bround(F.col("l") - F.col("f"), 2).alias("pqi_delta"),
        F.bround("m", 2).alias("morning_pqi_mean"),
        F.bround("d", 2).alias("midday_pqi_mean"),
    )


def altitude_class(scored: DataFrame, cut: bool | None = None) -> DataFrame:
    """Whether flights kept their height above ground or above the take-off point."""
    rel, absolute = finite_field(scored, "RelativeAltitude"), finite_field(scored, "AbsoluteAltitude")
    d = scored.select(rel.alias("rel"), (absolute - rel).alias("solo")).unpivot([], ["rel", "solo"], "k", "v")
    pct = order_statistics(d, ["k"], "v", {"a": 0.05, "b": 0.95}, "floor", cut=cut)
    span = F.bround(F.col("b") - F.col("a"), 2)
    one = pct.agg(
        F.max(F.when(F.col("k") == "rel", span)).alias("rel_range"),
        F.max(F.when(F.col("k") == "solo", span)).alias("solo_range"),
    )
    r = F.col("rel_range")
    return one.select(
        F.when(r >= 2.0, "Above Ground Level (AGL)")
        .when(r.isNotNull(), "Relative to Takeoff Point (ALT)")
        .otherwise(UNAVAILABLE)
        .alias("altitude_label"),
        F.when(r >= 2.0, "agl").when(r.isNotNull(), "relative").otherwise("unavailable").alias("altitude_type"),
        "rel_range",
        "solo_range",
    )


def terrain_slope(elevation_range: Column, area_ha: Column) -> Column:
    """Struct of slope in percent and its class; the class name doubles as a key."""
    pct = F.when(area_ha > 0, F.bround(elevation_range / F.sqrt(area_ha * 10000.0) * 100.0, 2))
    label = F.lit(UNAVAILABLE)
    for low, high, name in reversed(SLOPE_CLASSES):
        label = F.when((pct >= low) & (pct < high), name).otherwise(label)
    label = F.when(pct.isNull(), UNAVAILABLE).otherwise(label)
    kind = F.when(label == UNAVAILABLE, "unavailable").otherwise(F.replace(F.lower(label), F.lit(" "), F.lit("_")))
    return F.struct(pct.alias("slope_pct"), label.alias("slope_label"), kind.alias("slope_type"))


def gsd_stability(scored: DataFrame) -> DataFrame:
    v = finite_field(scored, "GroundSampleDistanceCm")
    one = scored.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    one = one.withColumn("cv", F.when(F.col("m") != 0, F.col("s") / F.col("m")).otherwise(0.0))
    few = F.col("n") < 2
    return one.select(
        F.when(few, "unavailable").when(F.col("cv") <= 0.05, "stable").otherwise("unstable").alias("gsd_stability_type"),
        F.when(~few, r4(F.col("m"))).alias("gsd_mean"),
        F.when(~few, r4(F.col("s"))).alias("gsd_std"),
        F.when(~few, r4(F.col("cv"))).alias("gsd_cv"),
    )


def flight_quality(altitude_type: Column, slope_pct: Column, stability: Column) -> Column:
    """Decision over altitude type, slope and pixel size stability."""
    missing = (altitude_type == "unavailable") | slope_pct.isNull() | (stability == "unavailable")
    relative = (
        F.when(slope_pct < 5, "Voo Coerente").when(slope_pct < 10, "AGL Recomendado").otherwise("AGL Necessario")
    )
    agl = F.when(stability == "stable", "Voo Coerente").otherwise("AGL Incoerente")
    return (
        F.when(missing, UNAVAILABLE)
        .when(altitude_type == "relative", relative)
        .when(altitude_type == "agl", agl)
        .otherwise(UNAVAILABLE)
    )


def strip_analysis(scored: DataFrame) -> DataFrame:
    """Images, score and overlap per strip; no rows when any photo lacks a strip number."""
    strip = finite_field(scored, "StripId")
    overlap = F.coalesce(*[finite_field(scored, f) for f in SERIES["overlap"]])
    d = scored.select(
        F.when(strip >= 0, F.floor(strip)).otherwise(F.ceil(strip)).cast("bigint").alias("strip_id"),
        "overall_score",
        overlap.alias("_o"),
    )
    g = d.groupBy("strip_id").agg(
        F.count(F.lit(1)).alias("images"),
        _mean2(F.col("overall_score")).alias("mean_score"),
        _mean2(F.col("_o")).alias("mean_overlap"),
        F.bround(F.count_if(F.col("_o") < 60.0) * 100.0 / F.nullif(F.count("_o"), F.lit(0)), 2).alias(
            "overlap_below_ideal_pct"
        ),
    )
    broken = g.agg(F.max(F.col("strip_id").isNull()).alias("_bad"))
    g = g.crossJoin(F.broadcast(broken)).filter(~F.coalesce("_bad", F.lit(False))).drop("_bad")  # one row
    bad = (F.col("mean_score") < 3.0) | (F.col("overlap_below_ideal_pct") > 30.0)
    return g.withColumn("problematic", F.coalesce(bad, F.lit(False)))


def dewarp_status(scored: DataFrame) -> DataFrame:
    zero = is_zero(raw(scored, "DewarpFlag"))
    per = scored.groupBy("flight_id").agg(F.count_if(zero).alias("z"))
    one = per.agg(
        F.coalesce(F.sum("z"), F.lit(0)).alias("dewarp_zero_count"),
        F.count_if(F.col("z") > 0).alias("flights_affected"),
        F.count(F.lit(1)).alias("flights"),
    )
    kind = (
        F.when(F.col("dewarp_zero_count") == 0, "ok")
        .when(F.col("flights_affected") == F.col("flights"), "critical")
        .otherwise("warn")
    )
    return one.withColumn("dewarp_status_type", kind)


def altitude_status(scored: DataFrame) -> DataFrame:
    missing = is_missing(raw(scored, "Alt")) & is_missing(raw(scored, "AbsoluteAltitude"))
    per = scored.groupBy("flight_id").agg(F.count_if(missing).alias("z"))
    one = per.agg(
        F.coalesce(F.sum("z"), F.lit(0)).alias("missing_altitude_count"),
        F.count_if(F.col("z") > 0).alias("flights_affected"),
    )
    return one.withColumn("altitude_status_type", F.when(F.col("missing_altitude_count") == 0, "ok").otherwise("warn"))


def doc_quality(df: DataFrame) -> DataFrame:
    """Counters of a photo document: coordinates, XMP, EXIF GPS."""
    source = F.upper(F.trim(F.coalesce(raw(df, "CoordSource"), F.lit(""))))
    xmp = F.coalesce(raw(df, "HasXmp").cast("boolean"), F.lit(False)) | (source == "XMP")
    exif = F.coalesce(raw(df, "HasExifGps").cast("boolean"), F.lit(False)) | (source == "EXIF")
    located = (source != "") & (source != "NONE")
    return df.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(located).alias("with_coords"),
        F.count_if(~located).alias("without_coords"),
        F.count_if(xmp).alias("with_xmp"),
        F.count_if(exif).alias("with_exif_gps"),
        F.count_if(~xmp & ~exif).alias("missing_xmp_and_exif"),
    )


def processing_summary(df: DataFrame, timestamps: str = "timestamps") -> DataFrame:
    """Duration of every stage from a map of start and end texts, one row per stage."""
    t = F.col(timestamps)

    def at(key: str) -> Column:
        return parse_ts(F.try_element_at(t, F.lit(key)), REPORT_FORMATS)

    stages = []
    for key, label in STAGES:
        seconds = (F.unix_micros(at(f"{key}_end")) - F.unix_micros(at(f"{key}_start"))) / 1e6
        stages.append(F.struct(F.lit(label).alias("label"), seconds.alias("_s")))
    whole = (F.unix_micros(at("report_end")) - F.unix_micros(at("pipeline_start"))) / 1e6
    others = [c for c in df.columns if c != timestamps]
    d = df.select(*others, whole.alias("_w"), F.array(*stages).alias("_stages"))
    summed = F.aggregate("_stages", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["_s"], F.lit(0.0)))
    total = F.coalesce("_w", F.when(summed > 0, summed))
    d = d.withColumn("total_seconds", F.bround(total, 3)).select(*others, "total_seconds", F.inline("_stages"))
    return d.select(
        *others,
        "label",
        F.bround("_s", 3).alias("duration_seconds"),
        stage_text(F.col("_s")).alias("duration_formatted"),
        F.col("_s").isNotNull().alias("present"),
        "total_seconds",
        stage_text(F.col("total_seconds")).alias("total_formatted"),
    )


def flight_series(
    df: DataFrame,
    value: str,
    order: Seq[str],
    flight: str = "flight_id",
    target: int = 100,
    positive_only: bool = False,
    cut: bool | None = None,
) -> DataFrame:
    """Means of equal runs of photos per flight, sized so the longest flight has ~``target``."""
    sizes = df.groupBy(flight).agg(F.count(F.lit(1)).alias("_n"))
    size = sizes.agg(F.greatest(F.lit(1), F.bround(F.max("_n") / float(target)).cast("bigint")).alias("_size"))
    seq = Sequence(df.select(flight, *order, F.col(value).alias("_v")), [flight], list(order), cut=cut)
    d = seq.number("_rn").result().crossJoin(F.broadcast(size))  # one row
    x = (F.floor((F.col("_rn") - 1) / F.col("_size")) + 1).alias("x")
    g = d.groupBy(flight, x).agg(F.avg(finite_num(F.col("_v"))).alias("_m")).filter(F.col("_m").isNotNull())
    if positive_only:
        g = g.filter(F.col("_m") > 0)
    return g.select(flight, "x", F.bround("_m", 2).alias("y"))


def hourly_means(df: DataFrame, columns: Seq[str], ts: str = "capture_ts", positive: Seq[str] = ()) -> DataFrame:
    """Means by time of day, all days together; the step follows the range of hours."""
    micros = F.unix_micros(F.date_trunc("second", F.col(ts)))
    hour = F.pmod(micros / 1e6, F.lit(86400.0)) / 3600.0
    vals = {}
    for c in columns:
        v = finite_num(F.col(c))
        vals[c] = F.when(v > 0, v) if c in positive else v
    d = df.select(hour.alias("_h"), *[v.alias(c) for c, v in vals.items()])
    any_value = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    d = d.filter(F.col("_h").isNotNull() & any_value)
    span = F.max("_h") - F.min("_h")
    minutes = (
        F.when((span <= 0) | (span > 10), 60).when(span <= 1, 10).when(span <= 3, 15).otherwise(30)
    )
    d = d.crossJoin(F.broadcast(d.agg(minutes.alias("interval_minutes"))))  # one row
    step = F.col("interval_minutes") / 60.0
    key = F.bround(F.col("_h") / step) * step
    d = d.withColumn("hour", F.when(key >= 24.0, 24.0 - step).otherwise(key))
    g = d.groupBy("hour", "interval_minutes").agg(
        *[F.bround(F.avg(c), 2).alias(f"{c}_mean") for c in columns],
        *[F.count(c).alias(f"{c}_count") for c in columns],
    )
    h = F.floor("hour")
    label = F.format_string("%02d:%02d", h, F.bround((F.col("hour") - h) * 60).cast("bigint"))
    return g.withColumn("label", label)
