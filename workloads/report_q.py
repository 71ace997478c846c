"""Report aggregates, alerts and series over derived photo records and plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions.rules import THRESHOLDS
from fieldspark.operators import alerts, photos, report
from fieldspark.plans.report_dataset import report_dataset
from workloads.inputs import table, with_sql
from workloads.photos_q import PHOTOS_SQL, _hav, level_sql, photo_records



def _scored(spark, sf):
    d = photos.with_numbers(photo_records(spark, sf)).withColumn("Model", F.col("DroneModel"))
    d = d.withColumns({"ExifImageWidth": F.lit(5280.0), "ExifImageHeight": F.lit(3956.0), "FocalLength": F.lit(12.0)})
    return report.score_images(d)


# Model "nope" (event % 3 = 2) has no sensor, so its sizes are null.
_REC = [
    PHOTOS_SQL,
    """rec AS (SELECT *, CASE i%3 WHEN 0 THEN 17.3 WHEN 1 THEN 6.4 END AS w, abs(gpitch) AS inc,
 (35+i%15)::DOUBLE AS temp, 'DJI_202405010800_00' || (i%7) || '_area' AS flight, 'DJI_' || i || '_0001.JPG' AS file,
 make_timestamp(t*1000000) AS ts FROM ph)""",
    """ind AS (SELECT *, CASE WHEN w IS NOT NULL THEN round_even(w*rel*100/(12*5280),4) END AS gsd_cm,
 CASE WHEN lrf > 0 THEN round(lrf*cos(radians(inc)),4) ELSE rel END AS fly,
 CASE WHEN i%11<>0 THEN abs(500+i%30-alt) END::DOUBLE AS zdiff,
 CASE WHEN exposure > 0 THEN round(log2(fnum*fnum/exposure),4) END AS ev FROM rec)""",
]
_SCORE_PARTS = {
    "gsd_cm": ("gsd_cm IS NOT NULL", level_sql("gsd_cm", "gsd_cm")),
    "orthorectification_potential": ("true", level_sql("orthorectification_potential", "(100-inc)")),
    "incidence_angle": ("true", level_sql("incidence_angle", "inc")),
    "sensor_temp_c": ("true", level_sql("sensor_temp_c", "temp")),
    "z_difference": ("zdiff IS NOT NULL", level_sql("z_difference", "zdiff")),
    "rtk_std_lon": ("true", level_sql("rtk_std_lon", "((i%12)::DOUBLE/100)")),
}


def indicator_levels(spark, sf):
    """Photos per level of six indicators."""
    long = report.scored_long(_scored(spark, sf)).filter(F.col("indicator").isin(*_SCORE_PARTS))
    return long.groupBy("indicator", "level").agg(F.count(F.lit(1)).alias("n"))


LEVELS_SQL = with_sql(
    _REC,
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS indicator, {lvl} AS level, count(*) AS n FROM ind WHERE {cond} GROUP BY 2"
        for n, (cond, lvl) in _SCORE_PARTS.items()
    ),
)


def indicator_statistics(spark, sf):
    d = report.indicator_statistics(_scored(spark, sf)).filter(F.col("indicator").isin("gsd_cm", "sensor_temp_c"))
    return d.select(
        "indicator", "mean", "std", F.round("value_mean", 3).alias("value_mean"), F.round("value_std", 3).alias("value_std"),
        "value_p5", "value_p95", *[f"level_{k}" for k in range(1, 6)],
    )


def _istats(name, value):
    lvl = f"coalesce(CASE WHEN {value} IS NOT NULL THEN {level_sql(name, value)} END, 3)"
    vals = f"list_sort(list({value}) FILTER ({value} IS NOT NULL))"
    return f"""SELECT '{name}' AS indicator, round(avg({lvl}),2) AS mean, round(stddev_samp({lvl}),2) AS std,
 round(avg({value}),3) AS value_mean, round(stddev_samp({value}),3) AS value_std,
 round({vals}[CAST(floor(0.05*(count({value})-1)) AS BIGINT)+1],4) AS value_p5, round({vals}[CAST(floor(0.95*(count({value})-1)) AS BIGINT)+1],4) AS value_p95,
 {', '.join(f'count(*) FILTER ({lvl} = {k}) AS level_{k}' for k in range(1, 6))} FROM ind"""


ISTATS_SQL = with_sql(_REC, _istats("gsd_cm", "gsd_cm") + "\nUNION ALL\n" + _istats("sensor_temp_c", "temp"))


def flights(spark, sf):
    d = report.aggregate_flights(_scored(spark, sf))
    return d.select(
        "flight_id", "images", "start", "end", "flight_seconds", "flight_time", "avg_sensor_temperature",
        "avg_lrf_target_distance", "avg_relative_altitude", "avg_absolute_altitude", "avg_iso", "avg_flight_yaw",
        "avg_shutter_speed_text",
        F.round(F.col("field_means")["GroundElevation"], 1).alias("ground"),
    )


FLIGHTS_SQL = with_sql(
    _REC,
    """SELECT flight AS flight_id, count(*) AS images, min(ts) AS start, max(ts) AS "end", max(t)-min(t) AS flight_seconds,
 printf('%02d:%02d:%02d', (max(t)-min(t))//3600, (max(t)-min(t))%3600//60, (max(t)-min(t))%60) AS flight_time,
 round(avg(temp),2) AS avg_sensor_temperature, round(avg(lrf),2) AS avg_lrf_target_distance, round(avg(rel),2) AS avg_relative_altitude,
 round(avg(alt),2) AS avg_absolute_altitude, round(avg(iso),2) AS avg_iso, round(avg(abs(fyaw)),2) AS avg_flight_yaw,
 '1/' || CAST(round(1/avg(CASE WHEN exposure > 0 THEN exposure END)) AS BIGINT) || 's' AS avg_shutter_speed_text,
 round(round(avg(alt-rel),2),1) AS ground FROM ind GROUP BY flight""",
)


_SEQUENCE = (
    "filename", "capture_ts", "Lat", "Lon", "Alt", "AbsoluteAltitude", "RelativeAltitude", "GimbalYawDegree", "FlightYawDegree",
    "i_speed_3d_ms", "i_coverage_width",
)


def sequence_indicators(spark, sf):
    # A long sequence is written down once, with all its columns: only those that are read.
    d = report.sequence_indicators(_scored(spark, sf).select(*_SEQUENCE))
    return d.select(
        "filename", "time_since_previous", F.round("geodesic_distance_previous", 2).alias("geodesic_distance_previous"),
        "trajectory_smoothness", "strip_id", "abrupt_change_flag", "is_valid_sequence_prev", "is_valid_sequence_next",
    )


_LAT, _LON = "lat + (i%3)/10000000", "lon"
SEQ_IND_SQL = with_sql(
    _REC,
    f"""SELECT filename, dt AS time_since_previous, round(d,2) AS geodesic_distance_previous, turn AS trajectory_smoothness,
 1 + CAST(sum(CASE WHEN turn > 45 THEN 1 ELSE 0 END) OVER (ORDER BY t, filename) AS BIGINT) AS strip_id,
 CASE WHEN dt IS NOT NULL THEN dt > 10 OR d > 100 END AS abrupt_change_flag,
 CASE WHEN dt > 0 AND dt <= 10 THEN 1 ELSE 0 END AS is_valid_sequence_prev,
 CASE WHEN nt-t > 0 AND nt-t <= 10 THEN 1 WHEN nt IS NOT NULL THEN 0 END AS is_valid_sequence_next
 FROM (SELECT *, (t-pt)::DOUBLE AS dt, {_hav('plat', 'plon', 'la', 'lon')} AS d,
  CASE WHEN abs(fyaw-pf)%360 > 180 THEN 360-abs(fyaw-pf)%360 ELSE abs(fyaw-pf)%360 END AS turn
  FROM (SELECT file AS filename, t, la, lon, fyaw, lag(t) OVER w AS pt, lag(la) OVER w AS plat, lag(lon) OVER w AS plon,
   lag(fyaw) OVER w AS pf, lead(t) OVER w AS nt FROM (SELECT *, {_LAT} AS la FROM ind) WINDOW w AS (ORDER BY t, file)))""",
)


def light_distribution(spark, sf):
    return report.light_distribution(_scored(spark, sf), photo_records(spark, sf)).drop("label_pt")


def by_prefix(spark, sf):
    d = table(spark, sf, "part").select(
        F.regexp_replace("p_name", " ", "_").alias("filename"), F.col("p_size").cast("double").alias("overall_score")
    )
    return report.by_prefix(d)


def last_shutter(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("camera_serial"),
        F.col("o_orderdate").alias("capture_ts"),
        F.col("o_orderkey").cast("double").alias("ShutterCount"),
        F.col("o_orderkey").cast("string").alias("filename"),
        F.col("o_orderstatus").alias("flight_id"),
    )
    return report.last_shutter(o).drop("flight_id")


SHUTTER_SQL = """SELECT camera_serial, o_orderkey::DOUBLE AS last_shutter_count, CAST(o_orderkey AS VARCHAR) AS file FROM (
 SELECT CAST(o_custkey AS VARCHAR) AS camera_serial, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders) WHERE rn = 1"""


def quality_trend(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("ts").alias("capture_ts"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("filename"),
        F.col("value").alias("PhotogrammetryQualityIndex"),
    )
    return report.quality_trend(e)


TREND_SQL = """WITH r AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
SELECT round(f,2) AS pqi_first_quartile_mean, round(l,2) AS pqi_last_quartile_mean, round(l-f,2) AS pqi_delta, round(m,2) AS morning_pqi_mean, round(d,2) AS midday_pqi_mean
FROM (SELECT avg(value) FILTER (rn <= n//4) AS f, avg(value) FILTER (rn > n - n//4) AS l, avg(value) FILTER (hour(ts) < 11) AS m,
 avg(value) FILTER (hour(ts) BETWEEN 11 AND 14) AS d FROM r)"""


def flight_series(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("flight_id"), "ts", "event_id", F.floor("value").cast("string").alias("value")
    )
    return report.flight_series(e, "value", ["ts", "event_id"])


SERIES_SQL = """WITH e AS (SELECT user_id%7 AS flight_id, floor(value) AS value, row_number() OVER (PARTITION BY user_id%7 ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT greatest(1, CAST(round_even(max(rn)/100.0::DOUBLE,0) AS BIGINT)) AS size FROM e)
SELECT flight_id, (rn-1)//size+1 AS x, round_even(avg(value),2) AS y FROM e, s GROUP BY 1, 2"""


def hourly_means(spark, sf):
    e = table(spark, sf, "events").select("ts", "value", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("half"))
    return report.hourly_means(e, ["value", "half"], "ts")


HOURLY_SQL = """WITH h AS (SELECT (epoch(date_trunc('second', ts)) % 86400)/3600.0::DOUBLE AS h, value, CASE WHEN event_id%2=0 THEN value END AS half FROM events),
k AS (SELECT CASE WHEN max(h)-min(h) <= 0 OR max(h)-min(h) > 10 THEN 60 WHEN max(h)-min(h) <= 1 THEN 10 WHEN max(h)-min(h) <= 3 THEN 15 ELSE 30 END AS m FROM h),
b AS (SELECT *, round_even(h/(m/60.0::DOUBLE),0)*(m/60.0::DOUBLE) AS key FROM h, k),
c AS (SELECT *, CASE WHEN key >= 24 THEN 24-m/60.0::DOUBLE ELSE key END AS hour FROM b)
SELECT hour, m AS interval_minutes, round(avg(value),2) AS value_mean, round(avg(half),2) AS half_mean, count(value) AS value_count, count(half) AS half_count,
 printf('%02d:%02d', CAST(floor(hour) AS BIGINT), CAST(round((hour-floor(hour))*60) AS BIGINT)) AS label FROM c GROUP BY hour, m"""


def gsd_stability(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("GroundSampleDistanceCm"))
    return report.gsd_stability(li)


def rtk_class(spark, sf):
    li = table(spark, sf, "lineitem").select((100 - F.col("l_quantity") / 2).alias("RtkStabilityScore"))
    return report.rtk_class(li)


def altitude_class(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("RelativeAltitude"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("AbsoluteAltitude")
    )
    return report.altitude_class(li)


ALTITUDE_SQL = """WITH v AS (SELECT list_sort(list(l_quantity)) AS a, list_sort(list(l_quantity + l_discount*100 - l_quantity)) AS s, count(*) AS n FROM lineitem),
p AS (SELECT round(a[CAST(floor(0.95*(n-1)) AS BIGINT)+1]-a[CAST(floor(0.05*(n-1)) AS BIGINT)+1],2) AS r, round(s[CAST(floor(0.95*(n-1)) AS BIGINT)+1]-s[CAST(floor(0.05*(n-1)) AS BIGINT)+1],2) AS q FROM v)
SELECT CASE WHEN r >= 2 THEN 'Above Ground Level (AGL)' ELSE 'Relative to Takeoff Point (ALT)' END AS altitude_label, CASE WHEN r >= 2 THEN 'agl' ELSE 'relative' END AS altitude_type,
 r AS rel_range, q AS solo_range FROM p"""


def strip_analysis(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("StripId"), (F.col("l_linenumber") % 6).cast("double").alias("overall_score"),
        (F.col("l_quantity") * 2).alias("PredictedOverlap"),
    )
    return report.strip_analysis(li)


STRIP_SQL = """SELECT l_suppkey AS strip_id, count(*) AS images, round(avg(l_linenumber%6),2) AS mean_score, round(avg(l_quantity*2),2) AS mean_overlap,
 round(count(*) FILTER (l_quantity*2 < 60)*100.0/count(*),2) AS overlap_below_ideal_pct,
 round(avg(l_linenumber%6),2) < 3 OR round(count(*) FILTER (l_quantity*2 < 60)*100.0/count(*),2) > 30 AS problematic FROM lineitem GROUP BY 1"""


def terrain_slope(spark, sf):
    p = table(spark, sf, "part")
    s = report.terrain_slope(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000)
    d = p.select("p_partkey", s.alias("s"))
    q = report.flight_quality(
        F.when(F.col("p_partkey") % 2 == 0, "agl").otherwise("relative"), F.col("s.slope_pct"),
        F.when(F.col("p_partkey") % 3 == 0, "stable").otherwise("unstable"),
    )
    return d.select("p_partkey", "s.slope_label", q.alias("quality"))


_PCT = "round(p_size / sqrt(p_retailprice/1000*10000) * 100, 2)"
SLOPE_SQL = "SELECT p_partkey, CASE " + " ".join(
    f"WHEN {_PCT} >= {a} AND {_PCT} < {b} THEN '{n}'" for a, b, n in report.SLOPE_CLASSES
) + f""" ELSE 'Indisponivel' END AS slope_label, CASE WHEN p_partkey%2=0 THEN CASE WHEN p_partkey%3=0 THEN 'Voo Coerente' ELSE 'AGL Incoerente' END
 WHEN {_PCT} < 5 THEN 'Voo Coerente' WHEN {_PCT} < 10 THEN 'AGL Recomendado' ELSE 'AGL Necessario' END AS quality FROM part"""


def photo_status(spark, sf):
    s = _scored(spark, sf)
    a, b = report.dewarp_status(s), report.altitude_status(s)
    return a.select("dewarp_zero_count", "dewarp_status_type").crossJoin(b.select("missing_altitude_count", "altitude_status_type"))


def doc_quality(spark, sf):
    return report.doc_quality(photo_records(spark, sf).drop("HasExifGps"))


def processing_summary(spark, sf):
    o = table(spark, sf, "orders")
    start = F.unix_timestamp("o_orderdate")

    def at(offset):
        return F.date_format(F.timestamp_seconds(start + offset), "yyyy-MM-dd'T'HH:mm:ss")

    k = F.col("o_orderkey") % 5000
    m = F.create_map(
        F.lit("mrk_start"), at(F.lit(0)), F.lit("mrk_end"), at(k), F.lit("xmp_start"), at(k), F.lit("xmp_end"), at(k * 2)
    )
    d = report.processing_summary(o.select("o_orderkey", m.alias("timestamps")))
    return d.filter("present").select("o_orderkey", "label", "duration_seconds", "total_seconds")


PROCESSING_SQL = """SELECT o_orderkey, l AS label, (o_orderkey%5000)::DOUBLE AS duration_seconds, CASE WHEN o_orderkey%5000 > 0 THEN (o_orderkey%5000*2)::DOUBLE END AS total_seconds
FROM orders, (VALUES ('MRK'),('XMP')) t(l)"""


def threshold_alerts(spark, sf):
    d = alerts.alerts_threshold(alerts.classified_for_alerts(_scored(spark, sf)))
    keep = ["sensor_temperature", "z_difference_alert", "rtk_type_alert", "yaw_alignment_error"]
    return d.filter(F.col("alert").isin(*keep)).select("alert", "severity", "category", "affected_count", "total_count", "affected_pct")


def _yaw():
    d = "abs(gyaw-fyaw)%360"
    return f"(CASE WHEN {d} > 180 THEN 360-{d} ELSE {d} END)"


ALERTS_SQL = with_sql(
    _REC,
    f"""SELECT alert, severity, category, n AS affected_count, t AS total_count, round(n*100.0/t,2) AS affected_pct FROM (
 SELECT 'sensor_temperature' AS alert, CASE WHEN count(*) FILTER ({level_sql('sensor_temp_c','temp')} <= 1) > 0 THEN 'CRITICO' ELSE 'ALERTA' END AS severity,
  'TEMPERATURE' AS category, CASE WHEN count(*) FILTER ({level_sql('sensor_temp_c','temp')} <= 1) > 0 THEN count(*) FILTER ({level_sql('sensor_temp_c','temp')} <= 1)
  ELSE count(*) FILTER ({level_sql('sensor_temp_c','temp')} <= 2) END AS n, count(*) AS t FROM ind
 UNION ALL SELECT 'z_difference_alert', 'ALERTA', 'GENERAL', count(*) FILTER ({level_sql('z_difference','zdiff')} <= 2), count(*) FROM ind WHERE zdiff IS NOT NULL
 UNION ALL SELECT 'rtk_type_alert', 'CRITICO', 'RTK_FLAG', count(*) FILTER (flag = 0), count(*) FROM ind
 UNION ALL SELECT 'yaw_alignment_error', 'ALERTA', 'YAW', count(*) FILTER ({level_sql('yaw_alignment_error', _yaw())} <= 1), count(*) FROM ind) WHERE n > 0""",
)


def flag_alerts(spark, sf):
    s = _scored(spark, sf)
    images = s.agg(F.count(F.lit(1)).alias("images"))
    d = alerts.alerts_rtk_flag(s).unionByName(alerts.alerts_aggregate(alerts.missing_flag_counts(s), images))
    d = d.unionByName(alerts.alerts_multi(alerts.classified_for_alerts(s)))
    return alerts.order_alerts(d).select("alert", "severity", "affected_count", "total_count")


FLAG_SQL = with_sql(
    _REC,
    f"""SELECT * FROM (SELECT 'rtk_flag_quality' AS alert, CASE WHEN avg(CASE WHEN flag=50 THEN 100.0 ELSE 0 END) < 80 THEN 'CRITICO' ELSE 'ALERTA' END AS severity,
 count(*) FILTER (flag <> 50) AS affected_count, count(*) AS total_count FROM ind
UNION ALL SELECT 'dewarp_disabled', 'CRITICO', count(*) FILTER (i%4=0), count(*) FROM ind
UNION ALL SELECT 'rtk_std_quality', CASE WHEN greatest(a,b,c) >= 50 THEN 'CRITICO' WHEN greatest(a,b,c) >= 20 THEN 'ALERTA' END, na+nb+nc, t FROM (
 SELECT count(*) FILTER ((i%7)::DOUBLE/100 > 0.05) AS na, count(*) FILTER ((i%12)::DOUBLE/100 > 0.05) AS nb, count(*) FILTER (i%19<>0 AND (i%9)::DOUBLE/50 > 0.1) AS nc,
  na*100.0/count(*) AS a, nb*100.0/count(*) AS b, nc*100.0/count(*) FILTER (i%19<>0) AS c, 2*count(*) + count(*) FILTER (i%19<>0) AS t FROM (
  SELECT i FROM ind) q)) WHERE severity IS NOT NULL""",
)


def std_alerts(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("flight_id"), (F.col("l_quantity") / 28).alias("GroundSampleDistanceCm")
    )
    return alerts.alerts_std(li).select("alert", "severity", "affected_count", "total_count")


def alert_summary(spark, sf):
    return alerts.alert_summary(alerts.all_alerts(_scored(spark, sf)))


def alert_photos(spark, sf):
    c = alerts.classified_for_alerts(_scored(spark, sf))
    return alerts.first_k_photos(alerts.affected_photos(c), 20).filter(F.col("alert") == "rtk_type_alert").select("filename", "level", "position")


PHOTOS20_SQL = with_sql(
    _REC,
    """SELECT filename, 1 AS level, position FROM (SELECT file AS filename, row_number() OVER (ORDER BY file) AS position FROM ind WHERE flag = 0) WHERE position <= 20""",
)


def recommendations(spark, sf):
    return alerts.recommendations(report.advanced_metrics(_scored(spark, sf)))


def advanced_metrics(spark, sf):
    d = report.advanced_metrics(_scored(spark, sf))
    return d.select("relative_altitude_mean", "relative_altitude_p5", "relative_altitude_p95", "lrf_target_mean", "flight_yaw_range",
                    "size_mb_mean", "size_mb_std", "rtk_diff_age_p95")


_FL = "list_sort(list({v}) FILTER ({v} IS NOT NULL))[CAST(floor({q}*(count({v})-1)) AS BIGINT)+1]"
METRICS_SQL = with_sql(
    _REC,
    f"""SELECT round(avg(rel),2) AS relative_altitude_mean, {_FL.format(v='rel', q=0.05)} AS relative_altitude_p5, {_FL.format(v='rel', q=0.95)} AS relative_altitude_p95,
 round(avg(lrf),2) AS lrf_target_mean, {_FL.format(v='fyaw', q=0.95)} - {_FL.format(v='fyaw', q=0.05)} AS flight_yaw_range,
 round(avg((i%90)::DOUBLE/10+4),4) AS size_mb_mean, round(stddev_samp((i%90)::DOUBLE/10+4),4) AS size_mb_std,
 {_FL.format(v='ag', q=0.95)} AS rtk_diff_age_p95 FROM (SELECT *, CASE WHEN i%13<>0 THEN age END AS ag FROM ind)""",
)


def general_info(spark, sf):
    return report.general_info(_scored(spark, sf))


GENERAL_SQL = with_sql(
    _REC,
    """SELECT DISTINCT 'equipment_models' AS kind, ['M4E','M3T','nope'][i%3+1] AS value FROM ind
UNION SELECT 'camera_models', ['M4E','M3T','nope'][i%3+1] FROM ind UNION SELECT 'equipment_serial_numbers', 'DRONE' || u FROM ind
UNION SELECT 'camera_serial_numbers', 'CAMERA-000123' FROM ind
UNION SELECT 'capture_start', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM ind UNION SELECT 'capture_end', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM ind""",
)


def pqi_summary(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_quantity") * 2).alias("PhotogrammetryQualityIndex"))
    return report.pqi_summary(li)


_PL = "greatest(1, least(5, 1 + " + " + ".join(f"CASE WHEN {{v}} >= {c} THEN 1 ELSE 0 END" for c in (45, 60, 75, 85, 95)) + "))"
PQISUM_SQL = f"""SELECT round(avg(l_quantity*2),2) AS pqi_mean, {_PL.format(v='avg(l_quantity*2)')} AS pqi_level,
 [{', '.join("'" + m + "'" for m in THRESHOLDS['photogrammetry_quality_index']['messages'])}][{_PL.format(v='avg(l_quantity*2)')}] AS pqi_label,
 {', '.join(f"count(*) FILTER ({_PL.format(v='l_quantity*2')} = {k}) AS level_{k}" for k in range(1, 6))} FROM lineitem"""


def _digest(df):
    """Rows, and the sum of the hashes of all their columns: no column can be left out of the plan."""
    kinds = dict(df.dtypes)
    of = lambda c: F.map_entries(f"`{c}`") if kinds[c].startswith("map<") else F.col(f"`{c}`")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*map(of, df.columns)) % 1_000_000_007).alias("digest"))


def full_report(spark, sf):
    """Every table of the report dataset, worked out with all its columns: rows and a digest of them."""
    d = photos.with_numbers(photo_records(spark, sf)).withColumn("Model", F.col("DroneModel"))
    out = None
    for name, one in report_dataset(d).items():
        one = _digest(one).select(F.lit(name).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


REGISTRY = {
    "indicator_levels": (indicator_levels, LEVELS_SQL),
    "indicator_statistics": (indicator_statistics, ISTATS_SQL),
    "flights": (flights, FLIGHTS_SQL),
    "sequence_indicators": (sequence_indicators, SEQ_IND_SQL),
    "light_distribution": (light_distribution, None),
    "by_prefix": (
        by_prefix,
        """SELECT CASE WHEN contains(p_name, ' ') OR contains(p_name, '_') THEN split_part(replace(p_name,' ','_'),'_',1) ELSE 'unknown' END AS model, count(*) AS count, round(avg(p_size),2) AS mean_score FROM part GROUP BY 1""",
    ),
    "last_shutter": (last_shutter, SHUTTER_SQL),
    "quality_trend": (quality_trend, TREND_SQL),
    "flight_series": (flight_series, SERIES_SQL),
    "hourly_means": (hourly_means, HOURLY_SQL),
    "gsd_stability": (
        gsd_stability,
        """SELECT CASE WHEN stddev_samp(l_quantity)/avg(l_quantity) <= 0.05 THEN 'stable' ELSE 'unstable' END AS gsd_stability_type, round_even(avg(l_quantity),4) AS gsd_mean,
 round(stddev_samp(l_quantity),4) AS gsd_std, round(stddev_samp(l_quantity)/avg(l_quantity),4) AS gsd_cv FROM lineitem""",
    ),
    "rtk_class": (
        rtk_class,
        """SELECT round(avg(100-l_quantity/2),4) AS rtk_stability_mean, CASE WHEN avg(100-l_quantity/2) >= 95 THEN 'Estavel' WHEN avg(100-l_quantity/2) >= 85 THEN 'Moderado'
 ELSE 'Instavel' END AS rtk_stability_class FROM lineitem""",
    ),
    "altitude_class": (altitude_class, ALTITUDE_SQL),
    "strip_analysis": (strip_analysis, STRIP_SQL),
    "terrain_slope": (terrain_slope, SLOPE_SQL),
    "photo_status": (
        photo_status,
        """SELECT count(*) FILTER (event_id%4=0) AS dewarp_zero_count, 'critical' AS dewarp_status_type, 0 AS missing_altitude_count, 'ok' AS altitude_status_type FROM events""",
    ),
    "doc_quality": (
        doc_quality,
        """SELECT count(*) AS total_files, count(*) FILTER (event_id%3<2) AS with_coords, count(*) FILTER (event_id%3=2) AS without_coords, count(*) FILTER (event_id%3=1) AS with_xmp,
 0 AS with_exif_gps, count(*) FILTER (event_id%3<>1) AS missing_xmp_and_exif FROM events""",
    ),
    "processing_summary": (processing_summary, PROCESSING_SQL),
    "threshold_alerts": (threshold_alerts, ALERTS_SQL),
    "flag_alerts": (flag_alerts, FLAG_SQL),
    "std_alerts": (
        std_alerts,
        """SELECT 'gsd_variation' AS alert, 'ALERTA' AS severity, count(*) FILTER (n >= 2 AND s > 0.5) AS affected_count, count(*) AS total_count
FROM (SELECT l_suppkey, count(*) AS n, stddev_samp(l_quantity/28) AS s FROM lineitem GROUP BY 1) HAVING count(*) FILTER (n >= 2 AND s > 0.5) > 0""",
    ),
    "alert_summary": (alert_summary, None),
    "alert_photos": (alert_photos, PHOTOS20_SQL),
    "recommendations": (recommendations, None),
    "advanced_metrics": (advanced_metrics, METRICS_SQL),
    "general_info": (general_info, GENERAL_SQL),
    "pqi_summary": (pqi_summary, PQISUM_SQL),
    "report_dataset": (full_report, None),
}
