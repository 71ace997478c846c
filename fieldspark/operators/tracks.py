"""Ordered point tracks: segment metrics, strip segmentation, lines."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import angles, geo
from fieldspark.functions.text import id_key, track_seconds
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence

_SORT = ["_k0", "_k1", "_k2", "_ts"]


def with_order(df: DataFrame, id_col: str | None = None, ts: str | None = None) -> DataFrame:
    """Add the sort columns of a track: numeric ids first, then text ids, then time."""
    out = df
    if id_col is None:
        out = out.withColumns({"_k0": F.lit(False), "_k1": F.lit(0.0), "_k2": F.lit("")})
    else:
        key = id_key(F.col(id_col))
        out = out.withColumn("_key", key).withColumns(
            {"_k0": F.col("_key.is_text"), "_k1": F.col("_key.number"), "_k2": F.col("_key.text")}
        ).drop("_key")
    if ts is None:
        return out.withColumn("_ts", F.lit(0.0))
    seconds = track_seconds(F.col(ts), dict(df.dtypes)[ts])
    return out.withColumn("_ts", F.coalesce(seconds, F.lit(0.0)))


def track(
    df: DataFrame,
    group: Seq[str],
    id_col: str | None = None,
    ts: str | None = None,
    fid: str = "fid",
    cut: bool | None = None,
) -> Sequence:
    return Sequence(with_order(df, id_col, ts), list(group), [*_SORT, fid], cut=cut)


def order_points(df: DataFrame, id_col: str, ts: str | None = None, fid: str = "fid") -> DataFrame:
    return with_order(df, id_col, ts).orderBy(*_SORT, fid).drop(*_SORT)


def _distance(geographic: bool, px: Column, py: Column, x: Column, y: Column) -> Column:
    f = geo.geodesic_distance if geographic else geo.planar_distance
    return f(px, py, x, y)


def _arrivals(d: DataFrame, w, x: str, y: str, geographic: bool) -> DataFrame:
    """Azimuth, distance, time step and speed of the segment that ends at each row."""
    px, py, pt = F.lag(x).over(w), F.lag(y).over(w), F.lag("_ts").over(w)
    d = d.withColumns({"_px": px, "_py": py, "_pt": pt})
    xc, yc = F.col(x), F.col(y)
    has = F.col("_px").isNotNull()
    d = d.withColumns(
        {
            "azimuth_prev": F.when(has, angles.azimuth(xc - F.col("_px"), yc - F.col("_py"))),
            "delta_distance": F.when(
                has, _distance(geographic, F.col("_px"), F.col("_py"), xc, yc)
            ).otherwise(0.0),
            "delta_time": F.when(has, F.greatest(F.col("_ts") - F.col("_pt"), F.lit(0.0))).otherwise(0.0),
        }
    )
    speed = F.when(F.col("delta_time") > 0, F.col("delta_distance") / F.col("delta_time")).otherwise(0.0)
    return d.withColumn("velocity_instant", speed).drop("_px", "_py", "_pt")


def segment_metrics(
    df: DataFrame,
    group: Seq[str],
    id_col: str | None = None,
    ts: str | None = None,
    fid: str = "fid",
    x: str = "x",
    y: str = "y",
    geographic: bool = False,
    cut: bool | None = None,
) -> DataFrame:
    """Azimuth, distance, time step and speed from the previous point of the group."""
    seq = track(df, group, id_col, ts, fid, cut)
    seq.bounded(1, lambda d, w: _arrivals(d, w, x, y, geographic))
    return seq.result().drop(*_SORT)


def _instant(d: DataFrame, w, keep: bool = False) -> DataFrame:
    """``keep`` leaves ``_sin`` and ``_cos`` of the azimuth from the previous point."""
    prev, nxt = F.col("azimuth_prev"), F.col("azimuth_next")
    d = d.withColumns({"_sin": angles.sine(prev), "_cos": angles.cosine(prev)})
    d = d.withColumns({n: F.lead(c).over(w) for n, c in (("azimuth_next", prev), ("_sinn", "_sin"), ("_cosn", "_cos"))})
    d = d.withColumn(
        "azimuth_instant",
        F.when(prev.isNull() | nxt.isNull(), F.coalesce(prev, nxt, F.lit(0.0))).otherwise(
            angles.from_sums(F.col("_sin") + F.col("_sinn"), F.col("_cos") + F.col("_cosn"))
        ),
    ).drop("_sinn", "_cosn")
    if not keep:
        d = d.drop("_sin", "_cos")
    az = F.col("azimuth_instant")
    zero = F.lit(0.0)
    return d.withColumns(
        {
            "delta_az_prev": F.coalesce(angles.angular_diff(az, prev), zero),
            "delta_az_next": F.coalesce(angles.angular_diff(az, nxt), zero),
        }
    )


def instant_azimuth(
    df: DataFrame,
    group: Seq[str],
    id_col: str | None = None,
    ts: str | None = None,
    fid: str = "fid",
    x: str = "x",
    y: str = "y",
    cut: bool | None = None,
) -> DataFrame:
    """Mean direction of the segments before and after each point, and the change to each."""
    seq = track(df, group, id_col, ts, fid, cut)
    seq.bounded(2, lambda d, w: _instant(_arrivals(d, w, x, y, False), w))
    return seq.result().drop(*_SORT)


def segment_strips(
    df: DataFrame,
    group: Seq[str] = (),
    id_col: str | None = None,
    ts: str | None = None,
    fid: str = "fid",
    x: str = "x",
    y: str = "y",
    severe: float = 45.0,
    window: int = 2,
    min_points: int = 20,
    max_distance: float = 0.0,
    geographic: bool = False,
    cut: bool | None = None,
) -> DataFrame:
    """Split tracks into strips where distance or mean direction breaks.

    A point starts a strip when it is farther than ``max_distance`` from the one
    before, or when the mean azimuth of the ``window`` segments before and after
    it differ by more than ``severe`` degrees.  Strips shorter than ``min_points``
    get ``shot_id`` "0".  ``shot_valid`` is always 0 for this method.
    """
    group = list(group)
    seq = track(df, group, id_col, ts, fid, cut)

    def breaks(d: DataFrame, w) -> DataFrame:
        d = _instant(_arrivals(d, w, x, y, geographic), w, keep=True)
        d = d.withColumns(
            {
                "_first": F.row_number().over(w) == 1,
                "_last": F.lead(fid).over(w).isNull(),
            }
        )
        back, ahead = w.rowsBetween(-window, -1), w.rowsBetween(1, window)
        turn = angles.angular_diff(
            angles.from_sums(F.sum("_sin").over(back), F.sum("_cos").over(back)),
            angles.from_sums(F.sum("_sin").over(ahead), F.sum("_cos").over(ahead)),
        )
        d = d.withColumn("_turn", turn)
        # The first row of a group has no arriving segment; pieces see it through their halo.
        inner = F.col("azimuth_prev").isNotNull()
        far = inner & (F.lit(max_distance) > 0) & (F.col("delta_distance") > max_distance)
        return d.withColumns(
            {
                "_far": far,
                "_break": far | (inner & F.coalesce(F.col("_turn") > severe, F.lit(False))),
                "_first": ~inner,
            }
        ).drop("_sin", "_cos", "_turn")

    seq.bounded(window + 2, breaks)
    seq.running(_shot=F.col("_break").cast("int")).total("_size", [*group, "_shot"])
    shot = (F.col("_shot") + 1).cast("string")
    valid = F.col("_size") >= min_points
    variation = F.greatest("delta_az_prev", "delta_az_next")
    seg_type = (
        F.when(F.col("_first"), "start")
        .when(F.col("_last"), "end")
        .when(F.col("_far"), "break_distance")
        .when(F.col("_break"), "break_direction")
        .when(~valid, "outlier")
        .when(
            # As whole numbers: 0.7 itself is no binary fraction.
            (F.lit(max_distance) > 0) & (F.col("delta_distance") * 10 > max_distance * 7), "gap_suspect"
        )
        .when(variation < 5, "straight")
        .when(variation < 15, "smooth_turn")
        .when(variation < severe, "sharp_turn")
        .when((F.col("delta_az_prev") > 20) & (F.col("delta_az_next") > 20), "zigzag")
        .otherwise("noisy")
    )
    out = seq.result().withColumns(
        {
            "shot_id": F.when(valid, shot).otherwise("0"),
            "old_shot_id": shot,
            "shot_valid": F.lit(0),
            "score": F.lit(0),
            "score_direction": F.lit(0),
            "score_continuity": F.lit(0),
            "seg_type": seg_type,
            "azimuth_mean": F.col("azimuth_instant"),
            "azimuth_prev": F.coalesce("azimuth_prev", F.lit(0.0)),
            "azimuth_next": F.coalesce("azimuth_next", F.lit(0.0)),
            "delta_time": F.lit(0.0),
            "velocity_instant": F.lit(0.0),
        }
    )
    return out.drop(*_SORT, "_first", "_last", "_far", "_break", "_shot", "_size")


def axial_smooth(seq: Sequence, azimuth: str, out: str, window: int = 3) -> Sequence:
    """Centred axial mean over ``window`` rows."""
    half = max(1, window // 2)
    return seq.bounded(
        half,
        lambda d, w: d.withColumn(
            out,
            F.when(
                F.count(azimuth).over(w.rowsBetween(-half, half)) > 0,
                angles.axial_mean(F.col(azimuth), w.rowsBetween(-half, half)),
            ),
        ),
    )


def stability_features(
    seq: Sequence, azimuth: str, future: int = 8, cluster: float = 15.0, past: int = 6
) -> Sequence:
    """Agreement of the next azimuths, spread of the past ones and their mean change."""
    az = F.col(azimuth)

    def body(d: DataFrame, w) -> DataFrame:
        ahead, behind = w.rowsBetween(1, future), w.rowsBetween(-past, -1)
        d = d.withColumns(
            {
                "_ahead": F.collect_list(az).over(ahead),
                "future_azimuth": F.when(
                    F.count(az).over(ahead) > 0, angles.axial_mean(az, ahead)
                ),
                "_behind": F.collect_list(az).over(behind),
                "past_variance": F.when(
                    F.count(az).over(behind) < 2, 1.0
                ).otherwise(angles.axial_var(az, behind)),
            }
        )
        agreed = F.size(
            F.filter("_ahead", lambda a: angles.axial_diff(a, F.col("future_azimuth")) <= cluster)
        )
        n = F.size("_behind")
        change = F.aggregate(
            F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")),
            F.lit(0.0),
            lambda acc, i: acc
            + angles.axial_diff(F.element_at("_behind", i), F.element_at("_behind", i - 1)),
        )
        size = F.size("_ahead")
        return d.withColumns(
            {
                "future_stability": F.when(size > 0, agreed / size).otherwise(0.0),
                "convergence_rate": F.when(n >= 2, change / (n - 1)).otherwise(0.0),
            }
        ).drop("_ahead", "_behind")

    return seq.bounded(max(future, past), body)


def time_score(delta_time: Column, frequency: float = 1.0, multiplier: float = 3.0) -> Column:
    """0, 1 or 4 by how far a time step exceeds the expected one."""
    limit = frequency * multiplier
    return F.when(delta_time > limit * 3.0, 4).when(delta_time > limit, 1).otherwise(0)


def points_to_lines(
    df: DataFrame,
    group: Seq[str],
    order: Seq[str],
    x: str = "x",
    y: str = "y",
    min_vertices: int = 2,
    aggs: dict[str, Column] | None = None,
) -> DataFrame:
    """One line per group with its vertices in order and ``aggs`` over its points.

    A line is one value, so a group must fit in one; `line_vertices` gives the same lines at any size as rows."""
    group, order = list(group), list(order)
    pt = geo.point(F.col(x), F.col(y))
    lines = df.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(*order, pt.alias("_pt")))).alias("_v"),
        F.count(F.lit(1)).alias("point_count"),
        *[c.alias(n) for n, c in (aggs or {}).items()],
    )
    lines = lines.filter(F.col("point_count") >= min_vertices)
    return lines.withColumn("geom", F.transform("_v", lambda v: v["_pt"])).drop("_v")


def line_vertices(
    df: DataFrame, group: Seq[str], order: Seq[str], x: str = "x", y: str = "y", min_vertices: int = 2
) -> DataFrame:
    """The lines of `points_to_lines` as one row per vertex, numbered from 1; a long line spans many tasks."""
    group = list(group)
    rows = df.select(*group, *order, F.col(x).alias("x"), F.col(y).alias("y"))
    d = Sequence(rows, group, list(order)).number("vertex").total("_n", group).result()
    return d.filter(F.col("_n") >= min_vertices).select(*group, "vertex", "x", "y")


def eligible_strip_points(df: DataFrame, shot: str = "shot_id", x: str = "x", y: str = "y") -> DataFrame:
    """Points of real strips: a shot that is neither null nor "0", and a position."""
    s = F.col(shot).cast("string")
    return df.filter(s.isNotNull() & (s != "0") & F.col(x).isNotNull() & F.col(y).isNotNull())


def strip_point_counts(df: DataFrame, shot: str = "shot_id", x: str = "x", y: str = "y") -> DataFrame:
    """Why points were left out of strip lines, as one row of counters."""
    s = F.col(shot).cast("string")
    has_geom = F.col(x).isNotNull() & F.col(y).isNotNull()
    real = s.isNotNull() & (s != "0")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(real & has_geom).alias("valid"),
        F.count_if(s.isNull()).alias("null_shot"),
        F.count_if(s == "0").alias("zero_shot"),
        F.count_if(real & ~has_geom).alias("no_geometry"),
        F.count_distinct(F.when(real & has_geom, s)).alias("shots"),
    )


def strip_lines(
    df: DataFrame,
    order: Seq[str],
    group: Seq[str] = (),
    source: str = "",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """One line per strip with its point count and mean azimuth."""
    pts = eligible_strip_points(df, x=x, y=y)
    aggs = {
        "shot_valid": F.min_by(F.col("shot_valid"), F.struct(*order)),
        "azimuth_mean": angles.circular_mean(F.col("azimuth_mean")),
        "source": F.lit(source),
    }
    return points_to_lines(pts, [*group, "shot_id"], order, x, y, aggs=aggs)
