"""Streams give the same rows as the batch operators."""

from pyspark.sql import functions as F

from fieldspark.operators import logs as batch
from fieldspark.operators.tracks import segment_strips
from fieldspark.sources.logs import parse_logs
from fieldspark.streaming import logs as live
from fieldspark.streaming.strips import stream_strips


def _write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def _line(minute, level, tool):
    return f'{{"ts":"2024-01-01T00:{minute:02d}:00","level":"{level}","tool":"{tool}","msg":"m{minute}"}}'


def test_logs_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.log", [_line(m, "ERROR" if m % 2 else "INFO", "t1") for m in range(10)] + ["broken {"])
    events = live.stream_logs(spark, str(src))
    kept = batch.filter_logs(events, text="m", levels=["ERROR"])
    out, mark = str(tmp_path / "out"), str(tmp_path / "cp")
    live.start(kept.select("ts", "tool", "msg"), out, mark).awaitTermination(60)
    assert spark.read.parquet(out).count() == 5
    _write(src, "b.log", [_line(m, "ERROR", "t2") for m in range(10, 13)])
    live.start(kept.select("ts", "tool", "msg"), out, mark).awaitTermination(60)
    lines = spark.read.text(str(src))
    expected = batch.filter_logs(parse_logs(lines), text="m", levels=["ERROR"]).select("ts", "tool", "msg")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, expected.collect()))


def test_error_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.log", [_line(m, "ERROR", "t") for m in range(0, 60, 3)])
    counts = live.error_windows(live.stream_logs(spark, str(src)), "10 minutes")
    q = counts.writeStream.format("memory").queryName("errs").outputMode("complete")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.window_start, r.tool): r.errors for r in spark.table("errs").collect()}
    want = batch.error_counts(parse_logs(spark.read.text(str(src))), "10 minutes").collect()
    assert got == {(r.window_start, r.tool): r.errors for r in want}


def test_strips_stream(spark, tmp_path):
    pts = [(i, 4.0 * i, 4.0 * i if i < 30 else 4.0 * (58 - i)) for i in range(60)]
    rows = [("v", i, float(i), x, y) for i, x, y in pts]
    df = spark.createDataFrame(rows, "vehicle string, fid long, ts double, x double, y double")
    df = df.withColumn("event_time", F.timestamp_seconds("ts"))
    src = str(tmp_path / "in")
    df.filter("fid < 25").coalesce(1).write.parquet(src)
    df.filter("fid >= 25").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_strips(stream).writeStream.format("memory").queryName("strips").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = {r.fid: str(r.shot) for r in spark.table("strips").collect()}
    whole = segment_strips(df, ["vehicle"], ts="ts", min_points=1)
    want = {r.fid: r.old_shot_id for r in whole.collect()}
    assert len(got) >= 56 and all(want[k] == v for k, v in got.items())


def test_strips_stream_ties_and_pauses(spark, tmp_path):
    """Points of one time in two batches, an early one that comes late, and a pause: no point is lost, no number repeats."""
    src = str(tmp_path / "in")
    schema = "vehicle string, fid long, ts double, x double, y double, event_time timestamp"

    def send(rows, vehicle="v"):
        df = spark.createDataFrame([(vehicle, f, 1000.0 + t, x, 0.0) for f, t, x in rows], "vehicle string, fid long, ts double, x double, y double")
        df.withColumn("event_time", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = stream_strips(stream, delay="5 seconds", idle_seconds=20).writeStream.format("parquet").outputMode("append")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination(60)

    send([(i, i // 2, 5.0 * i) for i in range(9)])
    send([(100, 3, 37.0), (9, 4, 45.0), (10, 5, 50.0), (11, 6, 55.0)])
    send([(900, 200, 0.0)], "other")
    send([(200, 500, 0.0), (201, 501, 5.0), (202, 502, 10.0), (203, 503, 15.0)])
    send([(901, 2000, 0.0)], "other")
    send([(902, 4000, 0.0)], "other")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r.fid: r.shot for r in rows}
    assert len(got) == len(rows) and set(got) >= {*range(12), 100, *range(200, 204)}
    assert {got[i] for i in (*range(12), 100)} == {1} and {got[i] for i in range(200, 204)} == {2}


def test_strips_stream_restarts(spark, tmp_path):
    """Two vehicles in small batches: a query that starts again from its checkpoint before each gives what one query gives."""
    import random

    rnd, schema = random.Random(9), "vehicle string, fid long, ts double, x double, y double, event_time timestamp"
    rows = [(v, i, float(i), 4.0 * i + rnd.random(), (4.0 * i if i % 40 < 20 else -4.0 * i) + rnd.random()) for i in range(80) for v in "ab"]
    src = str(tmp_path / "in")

    def run(out, checkpoint, most):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(src)
        q = stream_strips(stream, delay="5 seconds", idle_seconds=20).writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    for k in range(0, len(rows), 40):
        df = spark.createDataFrame(rows[k : k + 40], "vehicle string, fid long, ts double, x double, y double")
        df.withColumn("event_time", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(src)
        run("often", "cp1", 100)
    run("once", "cp2", 1)
    got, want = (sorted(map(tuple, spark.read.parquet(str(tmp_path / n)).collect())) for n in ("often", "once"))
    assert got == want and len(got) >= 150 and len({g[3] for g in got}) > 2
