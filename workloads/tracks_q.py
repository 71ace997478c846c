"""Ordered tracks and strip segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import tracks
from fieldspark.plans.ordered import Sequence
from workloads.inputs import SMOOTH_SQL, TRACK_SQL, smooth_points, track_points, with_sql
from workloads.tables_q import _pmod, _round


def _arrive(source: str, order: str, ts: str) -> str:
    az = _pmod("degrees(atan2(x - lag(x) OVER w, y - lag(y) OVER w))", 360)
    return f"""arr AS (SELECT *, {az} AS az,
  coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS dd,
  {ts} AS dt, row_number() OVER w AS i, lead(fid) OVER w AS nxt
  FROM {source} WINDOW w AS (PARTITION BY grp ORDER BY {order}))"""


_TS = "coalesce(greatest(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 0), 0)"


def segment_metrics(spark, sf):
    d = tracks.segment_metrics(track_points(spark, sf), ["grp"], ts="ts")
    return _round(d.select("fid", "azimuth_prev", "delta_distance", "delta_time", "velocity_instant"), digits=4)


METRICS_SQL = with_sql(
    [TRACK_SQL, _arrive("track", "ts, fid", _TS)],
    """SELECT fid, round(az,4) AS azimuth_prev, round(dd,4) AS delta_distance, round(dt,4) AS delta_time,
 round(CASE WHEN dt > 0 THEN dd/dt ELSE 0 END,4) AS velocity_instant FROM arr""",
)


def instant_azimuth(spark, sf):
    d = tracks.instant_azimuth(track_points(spark, sf), ["grp"], ts="ts")
    return _round(d.select("fid", "azimuth_instant", "delta_az_prev", "delta_az_next"), digits=4)


_INSTANT = f"""inst AS (SELECT *, lead(az) OVER w AS azn,
 CASE WHEN az IS NULL THEN coalesce(lead(az) OVER w, 0) WHEN lead(az) OVER w IS NULL THEN az
 ELSE {_pmod("degrees(atan2(sin(radians(az)) + sin(radians(lead(az) OVER w)), cos(radians(az)) + cos(radians(lead(az) OVER w))))", 360)} END AS ai
 FROM arr WINDOW w AS (PARTITION BY grp ORDER BY i)),
delta AS (SELECT *, coalesce(least(abs(ai-az)%360, 360-abs(ai-az)%360),0) AS dp,
 coalesce(least(abs(ai-azn)%360, 360-abs(ai-azn)%360),0) AS dn FROM inst)"""
INSTANT_SQL = with_sql(
    [TRACK_SQL, _arrive("track", "ts, fid", _TS), _INSTANT],
    "SELECT fid, round(ai,4) AS azimuth_instant, round(dp,4) AS delta_az_prev, round(dn,4) AS delta_az_next FROM delta",
)

_STRIP_COLUMNS = ["fid", "shot_id", "old_shot_id", "seg_type"]


def strips(spark, sf):
    d = tracks.segment_strips(
        track_points(spark, sf), ["grp"], ts="ts", severe=60.0, window=2, min_points=3, max_distance=90.0
    )
    return d.select(*_STRIP_COLUMNS, F.round("azimuth_instant", 4).alias("azimuth_instant"))


def strips_smooth(spark, sf):
    d = tracks.segment_strips(
        smooth_points(spark, sf), ["grp"], id_col="fid", severe=45.0, window=2, min_points=20
    )
    return d.select(*_STRIP_COLUMNS, F.round("azimuth_instant", 4).alias("azimuth_instant"))


def _strip_sql(ctes, order, severe, window, min_points, max_distance):
    diff = "abs(degrees(atan2(ps, pc)) - degrees(atan2(ns, nc)))"
    far = f"({max_distance} > 0 AND az IS NOT NULL AND dd > {max_distance})"
    return with_sql(
        [
            *ctes,
            _INSTANT,
            f"""sums AS (SELECT *, sum(sin(radians(az))) OVER b AS ps, sum(cos(radians(az))) OVER b AS pc,
 sum(sin(radians(az))) OVER a AS ns, sum(cos(radians(az))) OVER a AS nc FROM delta
 WINDOW b AS (PARTITION BY grp ORDER BY i ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY grp ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING))""",
            f"""brk AS (SELECT *, {far} AS far, {far} OR coalesce(az IS NOT NULL AND
 least({diff} % 360, 360 - {diff} % 360) > {severe}, false) AS br FROM sums)""",
            """shot AS (SELECT *, 1 + CAST(sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY i) AS BIGINT) AS s FROM brk)""",
            """sized AS (SELECT *, count(*) OVER (PARTITION BY grp, s) AS n FROM shot)""",
        ],
        f"""SELECT fid, CASE WHEN n >= {min_points} THEN CAST(s AS VARCHAR) ELSE '0' END AS shot_id,
 CAST(s AS VARCHAR) AS old_shot_id, CASE WHEN az IS NULL THEN 'start' WHEN nxt IS NULL THEN 'end'
 WHEN far THEN 'break_distance' WHEN br THEN 'break_direction' WHEN n < {min_points} THEN 'outlier'
 WHEN {max_distance} > 0 AND dd > {max_distance} * 0.7 THEN 'gap_suspect'
 WHEN greatest(dp,dn) < 5 THEN 'straight' WHEN greatest(dp,dn) < 15 THEN 'smooth_turn'
 WHEN greatest(dp,dn) < {severe} THEN 'sharp_turn' WHEN dp > 20 AND dn > 20 THEN 'zigzag' ELSE 'noisy' END AS seg_type,
 round(ai,4) AS azimuth_instant FROM sized""",
    )


STRIPS_SQL = _strip_sql([TRACK_SQL, _arrive("track", "ts, fid", _TS)], "ts, fid", 60.0, 2, 3, 90.0)
SMOOTH_STRIPS_SQL = _strip_sql([SMOOTH_SQL, _arrive("smooth", "fid", "0")], "fid", 45.0, 2, 20, 0.0)


def points_to_lines(spark, sf):
    from fieldspark.functions import geo

    d = tracks.points_to_lines(track_points(spark, sf), ["grp"], ["ts", "fid"])
    return d.select(
        "grp",
        "point_count",
        F.size("geom").alias("vertices"),
        F.round(geo.line_length(F.col("geom")), 4).alias("length"),
        F.col("geom")[0]["y"].alias("first_y"),
    )


def line_vertices(spark, sf):
    d = tracks.line_vertices(track_points(spark, sf), ["grp"], ["ts", "fid"])
    return d.select("grp", "vertex", "x", "y")


LINES_SQL = with_sql(
    [TRACK_SQL, _arrive("track", "ts, fid", _TS)],
    """SELECT grp, count(*) AS point_count, CAST(count(*) AS INTEGER) AS vertices, round(sum(dd),4) AS length,
 max(CASE WHEN i = 1 THEN y END) AS first_y FROM arr GROUP BY grp HAVING count(*) >= 2""",
)


def strip_lines(spark, sf):
    d = tracks.segment_strips(
        smooth_points(spark, sf), ["grp"], id_col="fid", severe=45.0, window=2, min_points=20
    )
    lines = tracks.strip_lines(d, ["fid"], ["grp"], source="smooth")
    return lines.select(
        "grp", "shot_id", "shot_valid", "point_count", F.round("azimuth_mean", 3).alias("azimuth_mean"), "source"
    )


STRIP_LINES_SQL = (
    SMOOTH_STRIPS_SQL.rsplit("SELECT fid, CASE", 1)[0]
    + f"""SELECT grp, CAST(s AS VARCHAR) AS shot_id, 0 AS shot_valid, count(*) AS point_count,
 round({_pmod("degrees(atan2(sum(sin(radians(ai))), sum(cos(radians(ai)))))", 360)},3) AS azimuth_mean, 'smooth' AS source
 FROM sized WHERE n >= 20 GROUP BY grp, s"""
)


def strip_point_counts(spark, sf):
    d = track_points(spark, sf).withColumn("shot_id", (F.col("fid") % 5).cast("string"))
    d = d.withColumn("shot_id", F.when(F.col("fid") % 7 != 0, F.col("shot_id")))
    return tracks.strip_point_counts(d)


STRIP_COUNTS_SQL = """SELECT count(*) AS total, count(*) FILTER (event_id%7<>0 AND event_id%5<>0) AS valid,
 count(*) FILTER (event_id%7=0) AS null_shot, count(*) FILTER (event_id%7<>0 AND event_id%5=0) AS zero_shot,
 0 AS no_geometry, count(DISTINCT CASE WHEN event_id%7<>0 AND event_id%5<>0 THEN event_id%5 END) AS shots FROM events"""


def axial_smooth(spark, sf):
    d = tracks.segment_metrics(track_points(spark, sf), ["grp"], ts="ts")
    seq = Sequence(d, ["grp"], ["ts", "fid"])
    tracks.axial_smooth(seq, "azimuth_prev", "smoothed", window=10)
    return seq.result().select("fid", F.round("smoothed", 4).alias("smoothed"))


SMOOTHED_SQL = with_sql(
    [TRACK_SQL, _arrive("track", "ts, fid", _TS)],
    f"""SELECT fid, round({_pmod(_pmod("degrees(atan2(sum(sin(radians(2*az))) OVER w, sum(cos(radians(2*az))) OVER w))", 360) + "/2", 180)},4) AS smoothed
 FROM arr WINDOW w AS (PARTITION BY grp ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""",
)


def stability_features(spark, sf):
    d = tracks.segment_metrics(track_points(spark, sf), ["grp"], ts="ts")
    seq = Sequence(d, ["grp"], ["ts", "fid"])
    tracks.stability_features(seq, "azimuth_prev")
    return _round(
        seq.result().select("fid", "future_stability", "past_variance", "convergence_rate"), digits=4
    )


_AXD = "least(abs({a}-{b})%180, 180-abs({a}-{b})%180)"
STABILITY_SQL = with_sql(
    [
        TRACK_SQL,
        _arrive("track", "ts, fid", _TS),
        f"""st AS (SELECT *, list(az) FILTER (az IS NOT NULL) OVER a AS al, list(az) FILTER (az IS NOT NULL) OVER b AS bl,
 {_pmod(_pmod("degrees(atan2(sum(sin(radians(2*az))) OVER a, sum(cos(radians(2*az))) OVER a))", 360) + "/2", 180)} AS fa,
 1 - sqrt(pow(avg(sin(radians(2*az))) OVER b, 2) + pow(avg(cos(radians(2*az))) OVER b, 2)) AS pv
 FROM arr WINDOW a AS (PARTITION BY grp ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING),
 b AS (PARTITION BY grp ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))""",
    ],
    f"""SELECT fid, round(CASE WHEN coalesce(len(al),0) = 0 THEN 0 ELSE
 len(list_filter(al, lambda q: {_AXD.format(a="q", b="fa")} <= 15)) / len(al) END,4) AS future_stability,
 round(CASE WHEN coalesce(len(bl),0) < 2 THEN 1 ELSE pv END,4) AS past_variance,
 round(CASE WHEN coalesce(len(bl),0) < 2 THEN 0 ELSE list_avg(list_transform(range(2, len(bl)+1), lambda k: {_AXD.format(a="bl[k]", b="bl[k-1]")})) END,4) AS convergence_rate
FROM st""",
)


def time_score(spark, sf):
    d = tracks.segment_metrics(track_points(spark, sf), ["grp"], ts="ts")
    return d.select("fid", tracks.time_score(F.col("delta_time"), 600.0, 3.0).alias("score"))


TIME_SCORE_SQL = with_sql(
    [TRACK_SQL, _arrive("track", "ts, fid", _TS)],
    "SELECT fid, CASE WHEN dt > 5400 THEN 4 WHEN dt > 1800 THEN 1 ELSE 0 END AS score FROM arr",
)

def strips_score(spark, sf):
    """Voting method."""
    from fieldspark.operators.strip_scans import segment_strips_score

    d = segment_strips_score(smooth_points(spark, sf), ["grp"], id_col="fid", min_points=20)
    return d.select(*_STRIP_COLUMNS, "score")


# One row after the other: votes on the row, votes on the next three, rows since the strip began.
_LEAVES = "CASE WHEN p.az IS NOT NULL AND p.a{k} IS NOT NULL AND abs((p.a{k} - base + 540 + 360) % 360 - 180) >= 15 THEN CASE WHEN since1 = 1 THEN 2 ELSE 1 END ELSE 0 END"
SCORE_SQL = with_sql(
    [
        SMOOTH_SQL,
        _arrive("smooth", "fid", "0"),
        _INSTANT,
        """pre AS (SELECT *, lead(az, 1) OVER w AS a1, lead(az, 2) OVER w AS a2, lead(az, 3) OVER w AS a3,
 sin(radians(az)) AS s0, cos(radians(az)) AS c0, coalesce(lag(sin(radians(az)), 1) OVER w, 0) AS s1, coalesce(lag(cos(radians(az)), 1) OVER w, 0) AS c1,
 coalesce(lag(sin(radians(az)), 2) OVER w, 0) AS s2, coalesce(lag(cos(radians(az)), 2) OVER w, 0) AS c2
 FROM delta WINDOW w AS (PARTITION BY grp ORDER BY i))""",
        f"""run AS (SELECT grp, i, fid, 0 AS votes, 0 AS v1, 0 AS v2, 0 AS v3, 0 AS since, 0 AS brk, 'start' AS kind FROM pre WHERE i = 1
 UNION ALL SELECT grp, i, fid, votes, CASE WHEN brk = 1 THEN 0 WHEN last THEN w1 ELSE w1 + l1 END, CASE WHEN brk = 1 THEN 0 WHEN last THEN w2 ELSE w2 + l2 END,
 CASE WHEN brk = 1 OR last THEN 0 ELSE l3 END, CASE WHEN brk = 1 THEN 0 ELSE since1 END, brk,
 CASE WHEN brk = 1 THEN 'break_direction' WHEN last THEN 'end' WHEN since1 = 1 THEN 'second' WHEN votes >= 3 THEN 'outlier' ELSE 'noisy' END
 FROM (SELECT *, {_LEAVES.format(k=1)} AS l1, {_LEAVES.format(k=2)} AS l2, {_LEAVES.format(k=3)} AS l3 FROM
 (SELECT pre.*, r.v1 AS votes, r.v2 AS w1, r.v3 AS w2, r.since + 1 AS since1, nxt IS NULL AS last,
 CASE WHEN r.v1 >= 3 AND NOT (r.v2 = 0 AND r.votes = 0) THEN 1 ELSE 0 END AS brk,
 degrees(atan2(s0 + CASE WHEN r.since >= 1 THEN s1 ELSE 0 END + CASE WHEN r.since >= 2 THEN s2 ELSE 0 END,
  c0 + CASE WHEN r.since >= 1 THEN c1 ELSE 0 END + CASE WHEN r.since >= 2 THEN c2 ELSE 0 END)) AS base
 FROM run r JOIN pre ON pre.grp = r.grp AND pre.i = r.i + 1) p))""",
        "shot AS (SELECT run.*, 1 + CAST(sum(brk) OVER (PARTITION BY grp ORDER BY i) AS BIGINT) AS s FROM run)",
        "sized AS (SELECT shot.*, az, azn, count(*) OVER (PARTITION BY shot.grp, s) AS n FROM shot JOIN delta USING (grp, i))",
    ],
    """SELECT fid, CASE WHEN n >= 20 THEN CAST(s AS VARCHAR) ELSE '0' END AS shot_id, CAST(s AS VARCHAR) AS old_shot_id,
 CASE WHEN kind IN ('start', 'break_direction', 'end', 'second') THEN kind WHEN n < 20 THEN 'outlier' WHEN t IS NULL OR t < 5 THEN 'straight'
 WHEN t < 15 THEN 'smooth_turn' WHEN t < 45 THEN 'sharp_turn' WHEN votes > 0 THEN 'zigzag' ELSE 'noisy' END AS seg_type, votes AS score
FROM (SELECT *, least(abs(az - azn) % 360, 360 - abs(az - azn) % 360) AS t FROM sized)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


def strips_full(spark, sf):
    """Full method; decided row by row, so there is no SQL."""
    from fieldspark.operators.strip_scans import StripSettings, segment_strips_full

    d = segment_strips_full(
        smooth_points(spark, sf), ["grp"], id_col="fid", settings=StripSettings(min_points=15)
    )
    return d.select("fid", "shot_id", "shot_valid", "seg_type", "score")


REGISTRY = {
    "segment_strips_score": (strips_score, SCORE_SQL),
    "segment_strips_full": (strips_full, None),
    "segment_metrics": (segment_metrics, METRICS_SQL),
    "instant_azimuth": (instant_azimuth, INSTANT_SQL),
    "segment_strips": (strips, STRIPS_SQL),
    "segment_strips_smooth": (strips_smooth, SMOOTH_STRIPS_SQL),
    "points_to_lines": (points_to_lines, LINES_SQL),
    "line_vertices": (
        line_vertices,
        with_sql(
            [TRACK_SQL, _arrive("track", "ts, fid", _TS)],
            "SELECT grp, i AS vertex, x, y FROM arr WHERE (SELECT count(*) FROM arr b WHERE b.grp = arr.grp) >= 2",
        ),
    ),
    "strip_lines": (strip_lines, STRIP_LINES_SQL),
    "strip_point_counts": (strip_point_counts, STRIP_COUNTS_SQL),
    "axial_smooth": (axial_smooth, SMOOTHED_SQL),
    "stability_features": (stability_features, STABILITY_SQL),
    "time_score": (time_score, TIME_SCORE_SQL),
}
