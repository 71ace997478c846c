"""Photo metadata: capture pipeline and quality index on records derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import catalog
from fieldspark.functions.rules import THRESHOLDS, classify
from fieldspark.operators import photos
from workloads.inputs import table, with_sql
from workloads.tables_q import _pmod

_CODES = list(catalog.LIGHT_SOURCES)


#: About 35 MB of scored records.
RECORDS_A_TASK = 50_000


def photo_records(spark, sf):
    """Photos three seconds apart, 20 folders, with gaps, jumps and missing values."""
    # A record is much wider than its event, so the rows are spread before records are built; the count is in the file.
    e = table(spark, sf, "events").select("event_id", "user_id")
    e = e.repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // RECORDS_A_TASK)))
    i = F.col("event_id")

    def text(c):
        return c.cast("string")

    def pick(options, expr):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (expr % len(options) + 1).cast("int"))

    return e.select(
        F.concat(F.lit("DJI_"), i, F.lit("_0001.JPG")).alias("File"),
        F.concat(F.lit("C:\\fly\\"), i, F.lit(".JPG")).alias("Path"),
        F.concat(F.lit("F"), F.col("user_id") % 20).alias("FolderLevel1"),
        F.date_format(
            F.timestamp_seconds(F.lit(1714521600) + i * 3), "yyyy:MM:dd HH:mm:ss"
        ).alias("DateTimeOriginal"),
        F.concat(F.lit("DRONE"), F.col("user_id") % 20).alias("DroneSerialNumber"),
        F.lit("CAMERA-000123").alias("CameraSerialNumber"),
        pick(["M4E", "M3T", "nope"], i).alias("DroneModel"),
        F.concat(F.lit("DJI_202405010800_00"), i % 7, F.lit("_area_Timestamp.MRK")).alias("MrkFile"),
        text(-15.0 + (i % 1000).cast("double") / 100000).alias("GpsLatitude"),
        text(-54.0 + (i * 7 % 1000).cast("double") / 100000).alias("GpsLongitude"),
        text(-15.0 + (i % 1000).cast("double") / 100000 + (i % 3).cast("double") / 10000000).alias("Lat"),
        text(-54.0 + (i * 7 % 1000).cast("double") / 100000).alias("Lon"),
        text(F.when(i % 11 != 0, (500 + i % 30).cast("double"))).alias("Alt"),
        F.concat(
            F.lit("+"), text(F.when(i % 97 == 0, 800 + i % 30).otherwise(500 + i % 30).cast("double"))
        ).alias("AbsoluteAltitude"),
        F.concat(F.lit("+"), text((80 + i % 40).cast("double"))).alias("RelativeAltitude"),
        text(F.when(i % 5 == 0, (90 + i % 20).cast("double"))).alias("LRFTargetDistance"),
        text(((i * 11) % 360 - 180).cast("double")).alias("GimbalYawDegree"),
        text((-90 + i % 25).cast("double")).alias("GimbalPitchDegree"),
        text((i % 4).cast("double")).alias("GimbalRollDegree"),
        text(((i * 17) % 360 - 180).cast("double")).alias("FlightYawDegree"),
        text((i % 5).cast("double")).alias("FlightPitchDegree"),
        text((i % 6).cast("double")).alias("FlightRollDegree"),
        text((i % 17 - 8).cast("double")).alias("FlightXSpeed"),
        text((i % 13 - 6).cast("double")).alias("FlightYSpeed"),
        text((i % 3).cast("double")).alias("FlightZSpeed"),
        text(F.when(i % 6 != 0, F.lit(1.0) / (i % 1000 + 100))).alias("ExposureTime"),
        text(F.lit(2.8) + (i % 4).cast("double") / 5).alias("FNumber"),
        text(((i % 8 + 1) * 100).cast("int")).alias("ISOSpeedRatings"),
        text((i % 50).cast("double")).alias("FocusDistance"),
        text((i * 40).cast("int")).alias("ShutterCount"),
        text((35 + i % 15).cast("double")).alias("SensorTemperature"),
        text(F.when(i % 4 == 0, (30 + i % 9).cast("double"))).alias("LensTemperature"),
        pick(["50", "34", "16", "0", "50", "50"], i).alias("RtkFlag"),
        text((i % 12).cast("double") / 100).alias("RtkStdLon"),
        text((i % 7).cast("double") / 100).alias("RtkStdLat"),
        text(F.when(i % 19 != 0, (i % 9).cast("double") / 50)).alias("RtkStdHgt"),
        text(F.when(i % 13 != 0, (i % 60).cast("double") / 10)).alias("RtkDiffAge"),
        F.when(i % 4 == 0, "0").when(i % 4 == 1, "1").alias("DewarpFlag"),
        text(pick(_CODES, i)).alias("LightSource"),
        text((2500 + i * 7 % 6000).cast("double")).alias("WhiteBalanceCCT"),
        text((i % 90).cast("double") / 10 + 4).alias("SizeMb"),
        F.when(i % 3 == 0, "MRK").when(i % 3 == 1, "XMP").otherwise("NONE").alias("CoordSource"),
        F.lit("OK").alias("QualityFlag"),
        F.lit(True).alias("HasExifGps"),
        F.col("event_id"),
    )


PHOTOS_SQL = """ph AS (SELECT event_id AS i, 'F' || (user_id % 20) AS folder, user_id % 20 AS u,
 1714521600 + event_id*3 AS t, -15.0::DOUBLE + (event_id%1000)/100000 AS lat, -54.0::DOUBLE + (event_id*7%1000)/100000 AS lon,
 CASE WHEN event_id%97=0 THEN 800+event_id%30 ELSE 500+event_id%30 END::DOUBLE AS alt, (80+event_id%40)::DOUBLE AS rel,
 CASE WHEN event_id%5=0 THEN 90+event_id%20 END::DOUBLE AS lrf,
 ((event_id*11)%360-180)::DOUBLE AS gyaw, (-90+event_id%25)::DOUBLE AS gpitch,
 ((event_id*17)%360-180)::DOUBLE AS fyaw, (event_id%5)::DOUBLE AS fpitch,
 sqrt(pow(event_id%17-8,2)+pow(event_id%13-6,2)+pow(event_id%3,2)) AS speed,
 CASE WHEN event_id%6<>0 THEN 1.0::DOUBLE/(event_id%1000+100) ELSE 0 END AS exposure, 2.8::DOUBLE+(event_id%4)/5 AS fnum,
 ((event_id%8+1)*100)::DOUBLE AS iso, (event_id%50)::DOUBLE*1000 AS focus, event_id*40 AS shutter,
 CASE event_id%3 WHEN 1 THEN 6.4 ELSE 17.3 END::DOUBLE AS sw, CASE event_id%3 WHEN 1 THEN 4.8 ELSE 13.0 END::DOUBLE AS sh,
 CASE event_id%3 WHEN 1 THEN 6.7 ELSE 12.29 END::DOUBLE AS f,
 ((event_id%12)::DOUBLE/100 + (event_id%7)::DOUBLE/100 + CASE WHEN event_id%19<>0 THEN (event_id%9)::DOUBLE/50 ELSE 999 END)/3 AS std,
 CASE WHEN event_id%13<>0 THEN (event_id%60)::DOUBLE/10 ELSE 999 END AS age,
 [50,34,16,0,50,50][event_id%6+1] AS flag FROM events)"""
_HAV = """2*6371000.0*atan2(sqrt({h}), sqrt(1-({h})))"""


def _hav(lat1, lon1, lat2, lon2):
    h = f"pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)"
    return _HAV.format(h=h)


_BEAR = _pmod(
    "degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat))-sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon))))",
    360,
)
SEQ_SQL = [
    PHOTOS_SQL,
    """lagged AS (SELECT *, lag(t) OVER w AS pt, lag(alt) OVER w AS palt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
 lag(gyaw) OVER w AS pgyaw, lag(speed) OVER w AS pspeed, lag(std) OVER w AS pstd, lag(shutter) OVER w AS psh FROM ph WINDOW w AS (PARTITION BY folder ORDER BY t, i))""",
    """val AS (SELECT *, coalesce(t-pt <= 120 AND abs(alt-palt) <= 200 AND abs(shutter-psh) <= 5000
 AND (t//86400) = (pt//86400), false) AS ok FROM lagged)""",
    f"""st AS (SELECT *, CASE WHEN ok THEN round(t-pt,2) ELSE 0 END AS dt, CASE WHEN ok THEN round({_hav('plat','plon','lat','lon')},2) ELSE 0 END AS d,
 CASE WHEN ok THEN round(sqrt(pow({_hav('plat','plon','lat','lon')},2)+pow(alt-palt,2)),2) ELSE 0 END AS d3,
 CASE WHEN ok THEN round({_BEAR},2) END AS dir FROM val)""",
    """ld AS (SELECT *, last_value(dir IGNORE NULLS) OVER (PARTITION BY folder ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ldir FROM st)""",
    """tn AS (SELECT *, coalesce(CASE WHEN (dir-ldir+360)%360 <= 180 THEN (dir-ldir+360)%360 ELSE 360-(dir-ldir+360)%360 END, 0) AS turn FROM ld)""",
    """seq AS (SELECT *, 1 + CAST(sum(CASE WHEN turn > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY t, i) AS BIGINT) AS strip,
 quantile_cont(CASE WHEN ok THEN dt END, 0.5) OVER (PARTITION BY folder) AS mt,
 quantile_cont(CASE WHEN ok THEN d END, 0.5) OVER (PARTITION BY folder) AS md FROM tn)""",
]


def level_sql(name: str, v: str) -> str:
    """CASE expression of a numeric rule."""
    r = THRESHOLDS[name]
    if r["type"] == "range_best":
        whens = " ".join(f"WHEN {v} BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(r["levels"], 1))
        return f"(CASE {whens} ELSE 3 END)"
    op = ">=" if r["type"] == "higher_better" else "<="
    cuts = [c if c != float("inf") else "'infinity'::DOUBLE" for c in r["levels"]]
    total = " + ".join(f"CASE WHEN {v} {op} {c} THEN 1 ELSE 0 END" for c in cuts)
    return f"greatest(1, least(5, {total}))"


def message_sql(name: str, level: str) -> str:
    texts = THRESHOLDS[name]["messages"]
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + f"][{level}]"


def photo_sequence(spark, sf):
    d = photos.photo_sequence(photo_records(spark, sf))
    return d.select(
        "event_id",
        "TimeSincePrevious",
        F.round("GeodesicDistancePrevious", 1).alias("GeodesicDistancePrevious"),
        F.round("DisplacementDirection", 1).alias("DisplacementDirection"),
        F.round("TrajectorySmoothness", 0).alias("TrajectorySmoothness"),
        F.col("StripId").cast("bigint").alias("StripId"),
        "AbruptChangeFlag",
    )


_RATIO = "greatest(CASE WHEN mt > 0 AND dt > 0 THEN dt/mt ELSE 1 END, CASE WHEN md > 0 AND d > 0 THEN d/md ELSE 1 END)"
SEQUENCE_SQL = with_sql(
    SEQ_SQL,
    f"""SELECT i AS event_id, dt::DOUBLE AS TimeSincePrevious, round(d,1) AS GeodesicDistancePrevious, round(coalesce(dir,0),1) AS DisplacementDirection,
 round(turn,0) AS TrajectorySmoothness, strip AS StripId, {message_sql('abrupt_change_flag', level_sql('abrupt_change_flag', _RATIO))} AS AbruptChangeFlag FROM seq""",
)

_OPT = [
    *SEQ_SQL,
    """h AS (SELECT *, CASE WHEN lrf > 0 THEN lrf*cos(radians(abs(90-abs(gpitch+fpitch)))) ELSE rel END AS hh FROM seq)""",
    """o AS (SELECT *, round(hh*sw/f,2) AS cw, round(hh*sh/f,2) AS ch, (hh*sw/(f*5280)*100 + hh*sh/(f*3956)*100)/2 AS gsd,
 sqrt(sw*sw+sh*sh) AS diag FROM h)""",
]


def optics(spark, sf):
    d = photos.optics(photos.ground_coverage(photos.with_camera(photo_records(spark, sf))))
    cols = ["CoverageWidth", "CoverageHeight", "GroundSampleDistanceCm", "MotionBlurRisk", "ExposureValueEv",
            "FOV", "CircleOfConfusion", "DOF", "HyperfocalDistance", "LightValue", "FocalLength35efl", "ShutterLifePct"]
    return d.select("event_id", *[F.round(c, 2).alias(c) for c in cols])


OPTICS_SQL = with_sql(
    _OPT,
    """SELECT i AS event_id, cw AS CoverageWidth, ch AS CoverageHeight, round(gsd,2) AS GroundSampleDistanceCm,
 round(speed*exposure/(gsd/100),2) AS MotionBlurRisk, CASE WHEN exposure > 0 THEN round(log2(fnum*fnum/exposure),2) ELSE 0 END AS ExposureValueEv,
 round(2*degrees(atan(diag/(2*f))),2) AS FOV, round(diag/1730,2) AS CircleOfConfusion, round(2*focus*focus*fnum*(diag/1730)/(f*f)/1000,2) AS DOF,
 round(f*f/(fnum*diag/1730)/1000,2) AS HyperfocalDistance, CASE WHEN exposure > 0 THEN round(log2(fnum*fnum*100/(exposure*iso)),2) ELSE 0 END AS LightValue,
 round(f*43.2666/diag,2) AS FocalLength35efl, round(shutter/400000*100,2) AS ShutterLifePct FROM o""",
)


def orientation(spark, sf):
    d = photos.orientation(photo_records(spark, sf))
    return d.select("event_id", "GimbalOffset", "YawRelativeError", "YawAlignmentError", "Nadir", "Directory")


_OFF = f"abs({_pmod('gyaw', 360)} - {_pmod('fyaw', 360)})"
ORIENTATION_SQL = with_sql(
    [PHOTOS_SQL],
    f"""SELECT i AS event_id, CASE WHEN {_OFF} > 150 AND {_OFF} < 300 THEN abs(180-{_OFF}) WHEN {_OFF} > 300 THEN abs(360-{_OFF}) ELSE {_OFF} END AS GimbalOffset,
 {_pmod('gyaw-fyaw', 360)} AS YawRelativeError, 0.0::DOUBLE AS YawAlignmentError,
 CASE WHEN abs(abs(gpitch)-90) <= 3 THEN 'Nadir' WHEN {_pmod('gyaw-fyaw', 360)} >= 315 OR {_pmod('gyaw-fyaw', 360)} < 45 THEN 'Obliqua - Frente'
 WHEN {_pmod('gyaw-fyaw', 360)} < 135 THEN 'Obliqua - Direita' WHEN {_pmod('gyaw-fyaw', 360)} < 225 THEN 'Obliqua - Tras' ELSE 'Obliqua - Esquerda' END AS Nadir,
 'file:///C:/fly/' || i || '.JPG' AS Directory FROM ph""",
)


def label_codes(spark, sf):
    d = photos.label_codes(photos.optics(photos.with_camera(photo_records(spark, sf))))
    return d.groupBy("LightSourceClassification", "LightCctCheck", "RtkType", "EvClassification").agg(
        F.count(F.lit(1)).alias("n")
    )


_EV = "(CASE WHEN exposure > 0 THEN round(log2(fnum*fnum/exposure),2) ELSE 0 END)"
EV_SQL = f"CASE WHEN {_EV} < 0 THEN 'Unknown' " + " ".join(
    f"WHEN {_EV} BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in catalog.EV_CLASSES
) + " ELSE 'Unknown' END"
_CODE = f"[{', '.join(map(str, _CODES))}][i % {len(_CODES)} + 1]"
_CCT = "(2500 + i*7 % 6000)"
_CHECK = "CASE " + " ".join(
    f"WHEN {_CODE} = {k} THEN CASE WHEN {_CCT} BETWEEN {a} AND {b} THEN 'Consistent' ELSE 'Inconsistent' END"
    for k, (a, b) in catalog.LIGHT_RANGES.items()
) + " ELSE 'Unknown' END"
_LABEL = f"CASE {_CODE} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in catalog.LIGHT_SOURCES.items()) + " END"
_RTK = "CASE flag WHEN 50 THEN 'RTK Fixed' WHEN 34 THEN 'RTK Float' WHEN 16 THEN 'RTK Single' ELSE 'Sem GPS' END"
LABELS_SQL = with_sql(
    [PHOTOS_SQL],
    f"""SELECT {_LABEL} AS LightSourceClassification, {_CHECK} AS LightCctCheck, {_RTK} AS RtkType, {EV_SQL} AS EvClassification, count(*) AS n
FROM ph GROUP BY ALL""",
)


def capture_scores(spark, sf):
    d = photos.photo_pipeline(photo_records(spark, sf))
    return d.select(
        "event_id",
        F.round("FOverlap", 1).alias("FOverlap"),
        "OrthorectificationPotential",
        "RtkEffectivePrecision",
        F.round("RtkStabilityScore", 1).alias("RtkStabilityScore"),
        F.round("GimbalAngularVelocity", 1).alias("GimbalAngularVelocity"),
        "VerticalStability",
        F.round("SpeedVariationIndex", 1).alias("SpeedVariationIndex"),
        F.round("CaptureEfficiency", 1).alias("CaptureEfficiency"),
    )


_OV = "(CASE WHEN ch <= 0 THEN 0 WHEN ok THEN greatest(0, least(100, (1-d/ch)*100)) ELSE 60 END)"
_INC = "round(abs(90-abs(gpitch+fpitch)),2)"
_LVL = level_sql("rtk_effective_precision", "std")
_GD = f"CASE WHEN {_pmod('gyaw-pgyaw', 360)} <= 180 THEN {_pmod('gyaw-pgyaw', 360)} ELSE 360-{_pmod('gyaw-pgyaw', 360)} END"
_STAB = """CASE WHEN ok THEN greatest(0, 100-least(100, abs(std-pstd)*100)) WHEN flag=50 AND std<0.01 THEN 99.5 WHEN flag=50 AND std<0.02 THEN 95
 WHEN std<0.02 THEN 90 WHEN std<0.05 THEN 80 WHEN std<0.1 THEN 60 WHEN std<1 THEN 30 ELSE 5 END"""
SCORES_SQL = with_sql(
    _OPT,
    f"""SELECT i AS event_id, round(round({_OV},2),1) AS FOverlap, (CASE WHEN {_LVL} >= 4 THEN 30 WHEN {_LVL}=3 THEN 15 ELSE 0 END
 + CASE WHEN {_INC} < 5 THEN 25 WHEN {_INC} < 15 THEN 15 ELSE 0 END + CASE WHEN i%4=0 THEN 0 ELSE 20 END
 + CASE WHEN age < 2 THEN 15 WHEN age < 5 THEN 8 ELSE 0 END + CASE WHEN {_OV} > 70 THEN 10 WHEN {_OV} > 50 THEN 5 ELSE 0 END)::DOUBLE AS OrthorectificationPotential,
 {message_sql('rtk_effective_precision', _LVL)} AS RtkEffectivePrecision, round(round({_STAB},2),1) AS RtkStabilityScore,
 round(round(CASE WHEN ok AND dt > 0 THEN ({_GD})/dt ELSE 0 END,2),1) AS GimbalAngularVelocity, CASE WHEN ok THEN abs(alt-palt) ELSE 0 END::DOUBLE AS VerticalStability,
 round(round(CASE WHEN ok AND speed+pspeed > 0 THEN abs(speed-pspeed)/2/((speed+pspeed)/2) ELSE 0 END,2),1) AS SpeedVariationIndex,
 round(round(CASE WHEN ok AND ch > 0 THEN d/ch ELSE 0 END,2),1) AS CaptureEfficiency FROM o""",
)


def mrk_differences(spark, sf):
    d = photos.mrk_differences(photo_records(spark, sf))
    return d.select("event_id", "XYDifference", "ZDifference", "3DDifference")


_ZD = "round(CASE WHEN i%11<>0 THEN 500+i%30 ELSE 0 END - alt, 2)"
_XY = f"round({_hav('lat + (i%3)/10000000', 'lon', 'lat', 'lon')}, 2)"
MRK_DIFF_SQL = with_sql(
    [PHOTOS_SQL],
    f"""SELECT i AS event_id, {_XY} AS XYDifference, {_ZD} AS ZDifference, round(sqrt(pow({_XY},2)+pow({_ZD},2)),2) AS "3DDifference" FROM ph""",
)


def quality_index(spark, sf):
    d = photos.photo_pipeline(photo_records(spark, sf))
    return d.select(
        "event_id",
        "PhotogrammetryQualityIndex",
        photos.pqi_label(F.col("PhotogrammetryQualityIndex")).alias("label"),
    )


_EVL = f"CASE {EV_SQL} " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS["ev_classification"]["mapping"].items()
) + " ELSE 3 END"
_STD3 = """((i%12)::DOUBLE/100 + (i%7)::DOUBLE/100 + CASE WHEN i%19<>0 THEN (i%9)::DOUBLE/50 ELSE 0 END)
 / CASE WHEN i%19<>0 THEN 3 ELSE 2 END"""
_PARTS = [
    (0.25, level_sql("motion_blur_risk", "round(speed*exposure/(gsd/100),2)")),
    (0.25, level_sql("predicted_overlap", f"round({_OV},2)")),
    (0.5, level_sql("speed_3d_ms", "round(speed,2)")),
    (2.0, _EVL),
    (1.0, level_sql("rtk_effective_precision", f"({_STD3})")),
    (1.0, level_sql("xy_difference", _XY)),
    (1.0, level_sql("z_difference", _ZD)),
    (2.0, "CASE WHEN i%4=0 THEN 1 ELSE 5 END"),
    (1.5, f"CASE WHEN i%13=0 THEN 3 ELSE {level_sql('rtk_diff_age', '(i%60)::DOUBLE/10')} END"),
]
_PQI = "round((" + " + ".join(f"(({lvl})-1)*25*{w}::DOUBLE" for w, lvl in _PARTS) + ")/9.5, 2)"
PQI_SQL = with_sql(
    [*_OPT, f"q AS (SELECT i, {_PQI} AS p FROM o)"],
    """SELECT i AS event_id, p AS PhotogrammetryQualityIndex, CASE WHEN p >= 90 THEN 'Excelente' WHEN p >= 80 THEN 'Muito boa'
 WHEN p >= 70 THEN 'Aceitável' WHEN p >= 50 THEN 'Risco moderado' ELSE 'Problemática' END AS label FROM q""",
)

_RULES = {
    "l_discount": {"type": "lower_better", "levels": [0.08, 0.06, 0.04, 0.02, float("inf")], "messages": list("abcde"), "mapping": {}},
    "l_quantity": {"type": "higher_better", "levels": [5, 10, 20, 30, 45], "messages": list("fghij"), "mapping": {}},
    "l_tax": {"type": "range_best", "levels": [[0, 0.02], [0.02, 0.04], [0.04, 0.05], [0.05, 0.06], [0.06, 0.07]],
              "messages": list("klmno"), "mapping": {}},
}


def scored_values(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_RULES, "l_extendedprice")
    long = li.unpivot(["l_orderkey", "l_linenumber"], [*_RULES, "l_extendedprice"], "indicator", "value")
    return classify(long, _RULES)


def classify_values(spark, sf):
    d = scored_values(spark, sf)
    return d.groupBy("indicator", "level", "message").agg(F.count(F.lit(1)).alias("n"))


def _rule_sql(name):
    r = _RULES[name]
    if r["type"] == "range_best":
        return "CASE " + " ".join(f"WHEN {name} BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(r["levels"], 1)) + " ELSE 3 END"
    op = ">=" if r["type"] == "higher_better" else "<="
    cuts = [c for c in r["levels"] if c != float("inf")]
    inf = 1 if float("inf") in r["levels"] else 0
    return f"greatest(1, least(5, {inf} + " + " + ".join(f"CASE WHEN {name} {op} {c} THEN 1 ELSE 0 END" for c in cuts) + "))"


CLASSIFY_SQL = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS indicator, {_rule_sql(n)} AS level, [{', '.join(repr(m) for m in r['messages'])}][{_rule_sql(n)}] AS message, count(*) AS n FROM lineitem GROUP BY ALL"
    for n, r in _RULES.items()
) + "\nUNION ALL SELECT 'l_extendedprice', 3, 'Indicator l_extendedprice nao configurado (OK default)', count(*) FROM lineitem"


def flight_ids(spark, sf):
    d = photos.resolve_capture_ts(photo_records(spark, sf))
    return d.groupBy(photos.flight_id(d).alias("serial"), photos.flight_id(d, "mrk").alias("mrk")).agg(
        F.count(F.lit(1)).alias("n")
    )


FLIGHT_SQL = with_sql(
    [PHOTOS_SQL],
    """SELECT left('DRONE' || u, 8) || '_CAMERA-0_' || strftime(make_timestamp(t*1000000), '%Y-%m-%d') AS serial,
 'DJI_202405010800_00' || (i%7) || '_area' AS mrk, count(*) AS n FROM ph GROUP BY ALL""",
)


def resolve_position(spark, sf):
    d = photo_records(spark, sf)
    e = F.col("event_id")
    d = d.withColumns(
        {
            "GpsLatitude": F.when(e % 3 == 0, "[15, 30/1, 36]").when(e % 3 == 1, F.col("GpsLatitude")),
            "GpsLongitude": F.when(e % 3 == 0, "[54, 0, 18]").when(e % 3 == 1, F.col("GpsLongitude")),
            "GpsLatitudeRef": F.lit("S"),
            "GpsLongitudeRef": F.lit("W"),
        }
    )
    p = photos.resolve_position(d)
    return p.select("event_id", F.round("geom.x", 7).alias("x"), F.round("geom.y", 7).alias("y"))


POSITION_SQL = with_sql(
    [PHOTOS_SQL],
    """SELECT i AS event_id, round(CASE WHEN i%3=0 THEN -54.005 ELSE lon END,7) AS x,
 round(CASE i%3 WHEN 0 THEN -15.51 WHEN 1 THEN lat ELSE lat+(i%3)/10000000 END,7) AS y FROM ph""",
)

REGISTRY = {
    "photo_sequence": (photo_sequence, SEQUENCE_SQL),
    "photo_optics": (optics, OPTICS_SQL),
    "photo_orientation": (orientation, ORIENTATION_SQL),
    "photo_labels": (label_codes, LABELS_SQL),
    "capture_scores": (capture_scores, SCORES_SQL),
    "mrk_differences": (mrk_differences, MRK_DIFF_SQL),
    "quality_index": (quality_index, PQI_SQL),
    "classify_values": (classify_values, CLASSIFY_SQL),
    "flight_ids": (flight_ids, FLIGHT_SQL),
    "resolve_position": (resolve_position, POSITION_SQL),
}
