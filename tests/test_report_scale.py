"""Report tables: photos are scored once, and records are dealt to as many tasks as they need."""

import statistics

from pyspark.sql import functions as F

from fieldspark.operators import photos, report
from fieldspark.plans.report_dataset import report_dataset
from workloads import photos_q, report_q


def test_indicator_statistics_scores_once(spark):
    scored_rows = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<indicator:string,value:string,level:int,message:string>>")
    def score(i):
        scored_rows.add(1)
        return [("a", str(i % 7 + 0.25), i % 5 + 1, None), ("b", "x" if i % 2 else None, 2, None)][: 1 + (i % 3 > 0)]

    scored = spark.range(300).select(
        F.col("id").cast("string").alias("filename"), F.lit("f").alias("flight_id"), score("id").alias("scored")
    )
    rows = {r.indicator: r for r in report.indicator_statistics(scored).collect()}
    assert scored_rows.value == 300
    values = [i % 7 + 0.25 for i in range(300)]
    a, b = rows["a"], rows["b"]
    assert a.value_mean == round(statistics.mean(values), 4) and a.value_std == round(statistics.stdev(values), 4)
    assert (a.value_min, a.value_max, a.value_range, a.value_p5, a.value_p95) == (0.25, 6.25, 6.0, 0.25, 6.25)
    assert a.mean == 3.0 and [a[f"level_{k}"] for k in range(1, 6)] == [60] * 5
    # A photo without the indicator counts as level 3.
    assert [b[f"level_{k}"] for k in range(1, 6)] == [0, 200, 100, 0, 0] and b.mean == 2.33
    assert b.value_mean is None and b.value_std is None and b.value_p95 is None


def test_records_are_dealt_by_their_number(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    monkeypatch.setattr(photos_q, "RECORDS_A_TASK", n // 40)
    assert photos_q.photo_records(spark, sf).rdd.getNumPartitions() >= 40


def test_full_report_has_every_table_with_all_columns(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("map<string,int>")
    def only_column(i):
        read.add(1)
        return {"k": i}

    tables = {
        "plain": spark.range(5),
        "costly": spark.range(7).select(only_column(F.col("id").cast("int")).alias("m")),
        "none": spark.range(0),
    }
    monkeypatch.setattr(report_q, "photo_records", lambda s, sf: s.range(0).withColumn("DroneModel", F.lit("x")))
    monkeypatch.setattr(report_q.photos, "with_numbers", lambda d: d)
    monkeypatch.setattr(report_q, "report_dataset", lambda d: tables)
    rows = {r.table: r for r in report_q.full_report(spark, "").collect()}
    assert {n: r.rows for n, r in rows.items()} == {"plain": 5, "costly": 7, "none": 0}
    # Counted alone, the column would not have been worked out.
    assert read.value == 7 and rows["costly"].digest != rows["plain"].digest


def test_scored_records_are_not_kept_in_memory(spark, sf):
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    d = photos.with_numbers(photos_q.photo_records(spark, sf)).withColumn("Model", F.col("DroneModel"))
    tables = report_dataset(d)
    plan = tables["sequence"]._jdf.queryExecution().optimizedPlan().toString()
    assert held() == before and "InMemoryRelation" not in plan and "parquet" in plan
    # A long sequence is written down with all its columns, so it has only those that it reads.
    assert "scored" not in tables["sequence"].columns and "strip_id" in tables["sequence"].columns
    assert tables["scored"].columns == report.score_images(d).columns
