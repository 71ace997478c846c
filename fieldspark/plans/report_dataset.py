"""All report tables of a photo set in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.rules import ALERTS, THRESHOLDS
from fieldspark.operators import alerts, report
from fieldspark.plans.sizing import stored

#: What the values against the photo before are worked out from, and what names the photo.
SEQUENCE_FIELDS = (
    "filename", "flight_id", "capture_ts", "Lat", "Lon", "Alt", "AbsoluteAltitude", "RelativeAltitude", "GimbalYawDegree",
    "FlightYawDegree", "i_speed_3d_ms", "i_coverage_width",
)


def report_dataset(
    records: DataFrame,
    thresholds: dict = THRESHOLDS,
    alert_rules: dict = ALERTS,
    partition_by: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Tables by name.

    Scored records are wide, so they are written down once and every table reads the columns it needs.  ``sequence`` has a
    row for each photo with its name, flight, time and values against the photo before; all else of it is in ``scored``.
    """
    scored = stored(report.score_images(records, thresholds), "scored-records")
    steps = scored.select(*[c for c in scored.columns if c in {*SEQUENCE_FIELDS, *(partition_by or [])}])
    flights = report.aggregate_flights(scored)
    metrics = report.advanced_metrics(scored)
    altitude, gsd = report.altitude_class(scored), report.gsd_stability(scored)
    area = report.total_area(flights)
    classified = alerts.classified_for_alerts(scored, alert_rules, thresholds)
    photos = alerts.affected_photos(classified, alert_rules, thresholds)
    found = alerts.all_alerts(scored, alert_rules, thresholds)
    verdict = (
        metrics.select("ground_elevation_range")
        .crossJoin(area)  # one row each
        .crossJoin(altitude)
        .crossJoin(gsd)
        .withColumn("slope", report.terrain_slope(F.col("ground_elevation_range"), F.col("total_area_ha")))
    )
    verdict = verdict.select(
        "*",
        "slope.*",
        report.flight_quality(
            F.col("altitude_type"), F.col("slope.slope_pct"), F.col("gsd_stability_type")
        ).alias("flight_quality"),
    ).drop("slope")
    order = ["capture_ts", "filename"]
    series = {
        name: report.flight_series(scored.withColumn("_v", report.raw(scored, *fields)), "_v", order, positive_only=positive)
        for name, fields, positive in (
            ("temperature_series", ("SensorTemperature",), False),
            ("lrf_series", ("LRFTargetDistance",), True),
            ("iso_series", ("ISOSpeedRatings", "RecommendedExposureIndex"), False),
        )
    }
    hourly = scored.select(
        "capture_ts",
        report.raw(scored, "SensorTemperature", "LensTemperature").alias("temp"),
        report.raw(scored, "LRFTargetDistance").alias("lrf"),
        report.raw(scored, "RelativeAltitude").alias("relz"),
    )
    iso = scored.select("capture_ts", report.raw(scored, "ISOSpeedRatings", "RecommendedExposureIndex").alias("iso"))
    return {
        "scored": scored,
        "scored_long": report.scored_long(scored),
        "sequence": report.sequence_indicators(steps, partition_by),
        "indicator_statistics": report.indicator_statistics(scored, thresholds),
        "pqi_summary": report.pqi_summary(scored, thresholds),
        "flights": flights,
        "total_area": area,
        "general_info": report.general_info(scored),
        "by_prefix": report.by_prefix(scored),
        "last_shutter": report.last_shutter(scored),
        "light_distribution": report.light_distribution(scored, records),
        "advanced_metrics": metrics,
        "rtk_class": report.rtk_class(scored),
        "quality_trend": report.quality_trend(scored),
        "flight_verdict": verdict,
        "strips": report.strip_analysis(scored),
        "dewarp_status": report.dewarp_status(scored),
        "altitude_status": report.altitude_status(scored),
        "hourly": report.hourly_means(hourly, ["temp", "lrf", "relz"], positive=["lrf"]),
        "iso_hourly": report.hourly_means(iso, ["iso"]),
        **series,
        "alerts": alerts.order_alerts(found),
        "alert_summary": alerts.alert_summary(found),
        "alert_flights": alerts.affected_flights(photos),
        "alert_photos": alerts.first_k_photos(photos),
        "recommendations": alerts.recommendations(metrics),
    }
