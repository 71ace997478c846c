"""Rule-driven alerts over scored photos.

Levels are counted once per indicator; the rules are evaluated on that small
table.  Affected flights and photos come as separate tables, so no alert row
carries a list that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.rules import ALERTS, SEVERITY_ORDER, THRESHOLDS, classify
from fieldspark.functions.text import finite_num, is_zero, is_missing, present
from fieldspark.operators.filters import enabled
from fieldspark.operators.photos import finite_field, has, raw
from fieldspark.operators.report import RECORD_INDICATORS

# Indicator -> record field an alert looks at before the derived value.
ALERT_FIELDS = {
    "motion_blur_risk": "MotionBlurRisk",
    "gsd_cm": "GroundSampleDistanceCm",
    "photogrammetry_quality_index": "PhotogrammetryQualityIndex",
    "predicted_overlap": "PredictedOverlap",
    "yaw_alignment_error": "YawAlignmentError",
    "gimbal_angular_velocity": "GimbalAngularVelocity",
    "gimbal_offset": "GimbalOffset",
    "rtk_std_lat": "RtkStdLat",
    "rtk_std_lon": "RtkStdLon",
    "rtk_std_hgt": "RtkStdHgt",
    "rtk_effective_precision": "RtkEffectivePrecision",
    "rtk_diff_age": "RtkDiffAge",
    "rtk_stability_score": "RtkStabilityScore",
    "sensor_temp_c": "SensorTemperature",
    "xy_difference": "XYDifference",
    "z_difference": "ZDifference",
    "speed_variation_index": "SpeedVariationIndex",
}
COLUMNS = (
    "alert string, severity string, category string, title string, detail string, impact string, action string, "
    "affected_count bigint, total_count bigint, affected_pct double, threshold_value double, actual_value double"
)


def alert_value(scored: DataFrame, indicator: str) -> Column:
    """Value an alert classifies: a number from the record, else the derived value.

    Category indicators keep their text.
    """
    rule = THRESHOLDS.get(indicator)
    derived = f"i_{indicator}"
    candidates = []
    if has(scored, ALERT_FIELDS.get(indicator, "")):
        candidates.append(raw(scored, ALERT_FIELDS[indicator]))
    if has(scored, derived):
        candidates.append(F.col(derived).cast("string"))
    if has(scored, RECORD_INDICATORS.get(indicator, "")):
        candidates.append(raw(scored, RECORD_INDICATORS[indicator]))
    if rule and rule["type"] == "categorical":
        values = [present(c) for c in candidates]
    else:
        values = [F.when(finite_num(c).isNotNull(), c) for c in candidates]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def _threshold_indicators(rules: dict) -> list[str]:
    names = []
    for r in rules.values():
        for n in [r["indicator"]] if r["mode"] == "threshold_levels" else r.get("indicators", []):
            if n not in names:
                names.append(n)
    return names


def classified_for_alerts(
    scored: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS, null_as_inf: bool = False
) -> DataFrame:
    """(filename, flight_id, indicator, level) of every indicator an alert needs."""
    names = _threshold_indicators(rules)
    wide = scored.select("filename", "flight_id", *[alert_value(scored, n).alias(n) for n in names])
    long = wide.unpivot(["filename", "flight_id"], names, "indicator", "value")
    return classify(long, thresholds, null_as_inf=null_as_inf).select(
        "filename", "flight_id", "indicator", "level"
    )


def _counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("indicator").agg(
        *[F.count_if(F.col("level") <= k).alias(f"upto_{k}") for k in range(1, 6)],
        F.count(F.lit(1)).alias("total"),
    )


def _cut(thresholds: dict, indicator: str, level: int) -> float | None:
    levels = thresholds.get(indicator, {}).get("levels", [])
    cut = levels[level - 1] if level <= len(levels) else None
    return float(cut) if isinstance(cut, (int, float)) else None


def _rules_table(spark, rules: dict, thresholds: dict, mode: str) -> DataFrame:
    rows = []
    for name, r in rules.items():
        if r["mode"] != mode:
            continue
        for ind in [r["indicator"]] if "indicator" in r else r["indicators"]:
            for i, rule in enumerate(r["rules"]):
                rows.append(
                    (
                        name,
                        ind,
                        i,
                        rule["severity"],
                        rule["type"],
                        int(rule["level"]),
                        float(rule.get("min_pct", 0.0)),
                        _cut(thresholds, ind, rule["level"]),
                    )
                )
    return spark.createDataFrame(
        rows,
        "alert string, indicator string, rule int, severity string, kind string, level int, min_pct double, cut double",
    )


def _texts(spark, rules: dict) -> DataFrame:
    rows = [(n, r["category"], r["title"], r["impact"], r["action"]) for n, r in rules.items()]
    return spark.createDataFrame(
        rows, "alert string, category string, title string, impact string, action string"
    )


def _finish(d: DataFrame, rules: dict) -> DataFrame:
    """Add texts and percentages and bring the columns in order."""
    # One row per rule name.
    out = d.join(F.broadcast(_texts(d.sparkSession, rules)), "alert")
    title = F.replace(
        F.replace("title", F.lit("{affected_count}"), F.col("affected_count").cast("string")),
        F.lit("{total_count}"),
        F.col("total_count").cast("string"),
    )
    if "title_override" in d.columns:
        title = F.coalesce("title_override", title)
    pct = F.when(
        F.col("total_count") > 0, F.bround(F.col("affected_count") * 100.0 / F.col("total_count"), 2)
    ).otherwise(0.0)
    out = out.withColumns({"title": title, "affected_pct": pct})
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = dict(c.split() for c in COLUMNS.split(", "))
    return out.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def _upto(level: str = "level") -> Column:
    out = F.col("upto_5")
    for k in range(1, 5):
        out = F.when(F.col(level) == k, F.col(f"upto_{k}")).otherwise(out)
    return out


def alerts_threshold(classified: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS) -> DataFrame:
    """First matching rule of every level alert."""
    spark = classified.sparkSession
    table = _rules_table(spark, rules, thresholds, "threshold_levels")
    d = _counts(classified).join(F.broadcast(table), "indicator")
    d = d.withColumn("n", _upto()).withColumn("pct", F.col("n") * 100.0 / F.col("total"))
    any_level = (F.col("kind") == "any_at_level") & (F.col("n") > 0)
    share = (F.col("kind") == "pct_at_level_or_worse") & (F.col("pct") > F.col("min_pct"))
    d = d.filter(any_level | share)
    first = d.groupBy("alert").agg(
        F.min_by(F.struct("indicator", "severity", "kind", "level", "n", "total", "pct", "cut"), "rule").alias("r")
    )
    d = first.select("alert", "r.*")
    return _finish(
        d.select(
            "alert",
            "severity",
            F.concat(
                F.col("n"), F.lit("/"), F.col("total"), F.lit(" imagens com "), F.col("indicator"),
                F.lit(" no nivel "), F.col("level"), F.lit("."),
            ).alias("detail"),
            F.col("n").alias("affected_count"),
            F.col("total").alias("total_count"),
            F.col("cut").alias("threshold_value"),
            F.when(F.col("kind") == "any_at_level", F.col("cut")).otherwise(F.col("pct")).alias("actual_value"),
        ),
        rules,
    )


def matched_levels(classified: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS) -> DataFrame:
    """(alert, indicator, level) of the rule that matched, to find affected rows."""
    spark = classified.sparkSession
    table = _rules_table(spark, rules, thresholds, "threshold_levels")
    d = _counts(classified).join(F.broadcast(table), "indicator")
    d = d.withColumn("n", _upto()).withColumn("pct", F.col("n") * 100.0 / F.col("total"))
    hit = ((F.col("kind") == "any_at_level") & (F.col("n") > 0)) | (
        (F.col("kind") == "pct_at_level_or_worse") & (F.col("pct") > F.col("min_pct"))
    )
    return d.filter(hit).groupBy("alert", "indicator").agg(F.min_by("level", "rule").alias("alert_level"))


def affected_photos(classified: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS) -> DataFrame:
    """All photos behind the level alerts."""
    hit = matched_levels(classified, rules, thresholds)
    # One row per alert.
    d = classified.join(F.broadcast(hit), "indicator").filter(F.col("level") <= F.col("alert_level"))
    return d.select("alert", "filename", "flight_id", "level")


def first_k_photos(affected: DataFrame, k: int = 20) -> DataFrame:
    """The first k photos of each alert, worst level first."""
    w = Window.partitionBy("alert").orderBy("level", "filename")
    return affected.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def affected_flights(affected: DataFrame) -> DataFrame:
    return affected.select("alert", "flight_id").distinct()


def alerts_multi(classified: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Alerts on the worst share among several indicators."""
    spark = classified.sparkSession
    table = _rules_table(spark, rules, thresholds, "threshold_levels_multi")
    d = _counts(classified).join(F.broadcast(table), "indicator")
    d = d.withColumn("n", _upto()).withColumn("pct", F.col("n") * 100.0 / F.col("total"))
    part = F.concat("indicator", F.lit(" > "), F.format_string("%.3f", F.col("cut")), F.lit(": "), F.format_string("%.2f%%", F.col("pct")))
    g = d.groupBy("alert", "rule", "severity", "min_pct").agg(
        F.max("pct").alias("worst"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min_by("cut", "indicator").alias("cut"),
        # A rule lists a handful of indicators.
        F.array_join(F.array_sort(F.collect_list(part)), " | ").alias("detail"),
    )
    g = g.filter(F.col("worst") >= F.col("min_pct"))
    first = g.groupBy("alert").agg(
        F.min_by(F.struct("severity", "detail", "n", "total", "cut", "worst"), "rule").alias("r")
    ).select("alert", "r.*")
    return _finish(
        first.select(
            "alert",
            "severity",
            "detail",
            F.col("n").alias("affected_count"),
            F.col("total").alias("total_count"),
            F.col("cut").alias("threshold_value"),
            F.lit(None).cast("double").alias("actual_value"),
        ),
        rules,
    )


def alerts_rtk_flag(scored: DataFrame, rules: dict = ALERTS) -> DataFrame:
    """Alerts on the share of photos without a fixed solution."""
    out = None
    for name, r in rules.items():
        if r["mode"] != "rtk_flag":
            continue
        fixed, floating, single = r["flags"]
        flag = finite_field(scored, "RtkFlag").cast("int")
        one = scored.agg(
            F.count_if(flag == fixed).alias("fixed"),
            F.count_if(flag == floating).alias("floating"),
            F.count_if(flag == single).alias("single"),
            F.count_if(flag.isNull() | ~flag.isin(fixed, floating, single)).alias("unknown"),
            F.count_if(flag != fixed).alias("non_fixed"),
            F.count_if(flag.isNull()).alias("no_flag"),
            F.count(F.lit(1)).alias("total"),
        ).filter(F.col("total") > 0)
        fixed_pct = F.col("fixed") * 100.0 / F.col("total")
        other_pct = F.col("non_fixed") * 100.0 / F.col("total")
        severity = F.lit(None).cast("string")
        for rule in reversed(r["rules"]):
            test = {
                "fixed_pct_lt": fixed_pct < rule["value"],
                "non_fixed_pct_gt": other_pct > rule["value"],
                "non_fixed_count_gt": F.col("non_fixed") > rule["value"],
            }[rule["type"]]
            severity = F.when(test, rule["severity"]).otherwise(severity)
        absent = F.col("unknown") == F.col("total")
        severity = F.when((F.col("non_fixed") == 0) & (F.col("unknown") == 0), None).when(absent, "INFO").otherwise(severity)
        detail = F.concat(
            F.format_string(f"RTK Fixa (Flag {fixed}): %d/%d (%.1f%%).", F.col("fixed"), F.col("total"), fixed_pct),
            F.format_string(f" RTK Flutuante (Flag {floating}): %d.", F.col("floating")),
            F.format_string(f" RTK Single (Flag {single}): %d.", F.col("single")),
            F.when(F.col("unknown") > 0, F.format_string(" Desconhecido: %d.", F.col("unknown"))).otherwise(""),
        )
        d = one.select(
            F.lit(name).alias("alert"),
            severity.alias("severity"),
            F.when(absent, "Nenhuma imagem possui o campo RtkFlag. Nao foi possivel avaliar a qualidade do sinal RTK.")
            .otherwise(detail)
            .alias("detail"),
            F.when(absent, "Flag RTK nao disponivel").alias("title_override"),
            F.when(absent, F.col("unknown")).otherwise(F.col("non_fixed")).alias("affected_count"),
            F.col("total").alias("total_count"),
            F.when(~absent, float(fixed)).alias("threshold_value"),
            F.when(~absent, fixed_pct).alias("actual_value"),
        ).filter(F.col("severity").isNotNull())
        d = _finish(d, rules)
        out = d if out is None else out.unionByName(d)
    return out


def alerts_std(scored: DataFrame, rules: dict = ALERTS) -> DataFrame:
    """Alerts on the deviation of an indicator inside flights."""
    out = None
    for name, r in rules.items():
        if r["mode"] != "aggregate_std":
            continue
        v = finite_num(alert_value(scored, r["indicator"]))
        per = scored.groupBy("flight_id").agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s"))
        limit = float(r["std_threshold"])
        one = per.agg(
            F.count_if((F.col("n") >= 2) & (F.col("s") > limit)).alias("affected_count"),
            F.count(F.lit(1)).alias("total_count"),
        ).filter(F.col("affected_count") > 0)
        d = one.select(
            F.lit(name).alias("alert"),
            F.lit(r["severity"]).alias("severity"),
            F.concat(
                F.col("affected_count"), F.lit(f" voo(s) com desvio padrao de {r['indicator']} > {limit}.")
            ).alias("detail"),
            "affected_count",
            "total_count",
            F.lit(limit).alias("threshold_value"),
            F.lit(None).cast("double").alias("actual_value"),
        )
        d = _finish(d, rules)
        out = d if out is None else out.unionByName(d)
    return out


def alerts_aggregate(totals: DataFrame, images: DataFrame, rules: dict = ALERTS) -> DataFrame:
    """Alerts on a named field of a one-row aggregate table.

    ``images`` is a one-row table with the photo count as ``images``.
    """
    out = None
    d0 = totals.crossJoin(images)  # one row each
    for name, r in rules.items():
        if r["mode"] != "aggregate_field" or not has(totals, r["aggregate_field"]):
            continue
        v = F.coalesce(F.col(r["aggregate_field"]).cast("double"), F.lit(0.0))
        op, limit = r["condition"]
        met = {"gt": v > limit, "gte": v >= limit, "eq": v == limit, "lt": v < limit}[op]
        severity = F.lit(r.get("severity")).cast("string")
        if not r.get("severity"):
            pct = v * 100.0 / F.col("images")
            for rule in reversed(r["rules"]):
                severity = F.when(pct > rule["value"], rule["severity"]).otherwise(severity)
        n = v.cast("bigint")
        d = d0.filter(met).select(
            F.lit(name).alias("alert"),
            severity.alias("severity"),
            F.concat(n, F.lit("/"), F.col("images"), F.lit(" imagens afetadas.")).alias("detail"),
            n.alias("affected_count"),
            F.col("images").alias("total_count"),
            F.lit(None).cast("double").alias("threshold_value"),
            F.lit(None).cast("double").alias("actual_value"),
        ).filter(F.col("severity").isNotNull())
        d = _finish(d, rules)
        out = d if out is None else out.unionByName(d)
    return out


def missing_flag_counts(scored: DataFrame) -> DataFrame:
    """One row with the counters the aggregate alerts test."""
    return scored.agg(
        F.count_if(is_zero(raw(scored, "DewarpFlag"))).alias("dewarp_zero_count"),
        F.count_if(is_missing(raw(scored, "Alt")) & is_missing(raw(scored, "AbsoluteAltitude"))).alias(
            "missing_altitude_count"
        ),
    )


def all_alerts(
    scored: DataFrame, rules: dict = ALERTS, thresholds: dict = THRESHOLDS, null_as_inf: bool = False
) -> DataFrame:
    """Every alert of every mode."""
    rules = enabled(rules)
    classified = classified_for_alerts(scored, rules, thresholds, null_as_inf)
    images = scored.agg(F.count(F.lit(1)).alias("images"))
    parts = [
        alerts_threshold(classified, rules, thresholds),
        alerts_multi(classified, rules, thresholds),
        alerts_rtk_flag(scored, rules),
        alerts_std(scored, rules),
        alerts_aggregate(missing_flag_counts(scored), images, rules),
    ]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def order_alerts(alerts: DataFrame) -> DataFrame:
    """Worst severity first, then category, then the larger share."""
    rank = F.lit(99)
    for name, i in SEVERITY_ORDER.items():
        rank = F.when(F.col("severity") == name, i).otherwise(rank)
    return alerts.orderBy(rank, "category", F.desc("affected_pct"), "alert")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alerts per category and severity."""
    return alerts.groupBy("category").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER],
        F.count(F.lit(1)).alias("total"),
    )


# Advice per exceeded metric, in this order.
ADVICE = (
    ("overlap_below_ideal_pct", 30, "Aumentar overlap para >=70% nas proximas missoes e repetir faixas com baixa sobreposicao."),
    ("yaw_inconsistent_pct", 5, "Padronizar heading e evitar alternancia de sentido sem estrategia de bloco."),
    ("gimbal_offset_over_1deg_pct", 20, "Recalibrar gimbal e validar alinhamento antes da decolagem."),
    ("rtk_diff_age_p95", 2, "Melhorar vinculacao RTK/base e reduzir idade de correcao RTK durante o voo."),
    ("light_inconsistent_pct", 20, "Planejar janelas de luz mais estaveis e reduzir mudancas bruscas de iluminacao."),
)
ALL_GOOD = "Parametros principais estaveis. Manter padrao operacional atual e monitorar indicadores criticos."


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice for every exceeded metric of a one-row metrics table."""
    found = F.array_compact(F.array(*[F.when(F.col(m) > limit, text) for m, limit, text in ADVICE]))
    texts = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ALL_GOOD)))
    return metrics.select(F.posexplode(texts).alias("position", "recommendation"))
