"""Files written from the driver's tables and read back: streams of log lines, text grids, image metadata."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from fieldspark.operators import logs as batch
from fieldspark.plans.sizing import ensure_checkpoint_dir
from fieldspark.sources import files
from fieldspark.sources.ranges import create_file
from fieldspark.streaming import logs as live
from workloads.inputs import PIXELS_SQL, pixels, table, with_sql
from workloads.logs_q import EVENTS_SQL, json_lines


def _folder(spark, name: str) -> str:
    """A new folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, sf, of, mode="append"):
    """What a live query gives in two runs: half of the lines are there at first, half come before the second run."""
    base = _folder(spark, "live-logs")
    lines = json_lines(spark, sf).withColumn("_half", F.pmod(F.xxhash64("value"), F.lit(2)))
    for half in (0, 1):
        lines.filter(F.col("_half") == half).select("value").write.mode("append").text(f"{base}/in")
        events = live.stream_logs(spark, f"{base}/in", "part-*", range_bytes=1 << 18)
        live.start(of(events), f"{base}/out", f"{base}/checkpoint", mode=mode).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def appended_logs(spark, sf):
    return _streamed(spark, sf, lambda e: e.select("session_id", "level", "tool", "msg", "event_time"))


def filtered_stream(spark, sf):
    return _streamed(spark, sf, lambda e: batch.filter_logs(e, text="CLICK", levels=["ERROR", "CRITICAL", "INFO"]).select("session_id", "level", "tool"))


def ascii_grids(spark, sf):
    """The rasters as text grids, read in ranges of a few kilobytes."""
    base = _folder(spark, "text-grids")

    def write(raster: pd.DataFrame) -> pd.DataFrame:
        held = {(r, c): v for r, c, v in zip(raster["row"], raster["col"], raster["value"], strict=True)}
        head = ["ncols 64", "nrows 64", "xllcorner 10", "yllcorner 20", "cellsize 0.5", "NODATA_value -9999"]
        body = [" ".join(repr(float(held.get((r, c), -9999.0))) for c in range(64)) for r in range(64)]
        name = str(raster["raster_id"].iloc[0])
        create_file(f"{base}/{name}.asc", ("\n".join(head + body) + "\n").encode())
        return pd.DataFrame({"name": [name]})

    pixels(spark, sf).groupBy("raster_id").applyInPandas(write, "name string").count()
    px, grids = files.read_ascii_grid(spark, base, 4096)
    known = px.join(grids.select("raster_id", "y0", "nodata"), "raster_id").filter("value <> nodata")
    return known.select(F.col("raster_id").cast("int").alias("raster_id"), "row", "col", "y0", F.round("value", 6).alias("value"))


def image_metadata(spark, sf):
    """An image a supplier whose metadata block stands at its end or, in every third, at its beginning."""
    base = _folder(spark, "images")

    def write(batches):
        for b in batches:
            for k, balance, phone in zip(b["s_suppkey"], b["s_acctbal"], b["s_name"], strict=True):
                block = f'<x:xmpmeta><rdf:Description drone-dji:GpsLatitude="{balance}" tiff:Model="{phone}"></rdf:Description></x:xmpmeta>'
                filler = bytes([int(k) % 251]) * 100_000
                parts = (block.encode(), filler) if k % 3 == 0 else (filler, block.encode())
                create_file(f"{base}/{k}.jpg", b"".join(parts))
            yield b[["s_suppkey"]]

    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    rows.mapInPandas(write, "s_suppkey long").count()
    d = files.read_xmp(spark, base)
    return d.select(
        F.regexp_extract("File", r"(\d+)", 1).cast("long").alias("image"),
        F.try_element_at("attributes", F.lit("GpsLatitudeXmp")).cast("double").alias("latitude"),
        F.try_element_at("attributes", F.lit("Model")).alias("model"),
    )


REGISTRY = {
    "appended_logs": (
        appended_logs,
        with_sql([EVENTS_SQL], "SELECT session_id, level, tool, msg, ts AS event_time FROM ev"),
    ),
    "filtered_stream": (
        filtered_stream,
        with_sql(
            [EVENTS_SQL],
            "SELECT session_id, level, tool FROM ev WHERE level IN ('ERROR','CRITICAL','INFO') AND contains(lower(msg || ' ' || data), 'click')",
        ),
    ),
    "ascii_grids": (
        ascii_grids,
        with_sql([PIXELS_SQL], "SELECT raster_id::INT AS raster_id, row, col, 52.0::DOUBLE AS y0, round(value,6) AS value FROM pixels"),
    ),
    "image_metadata": (
        image_metadata,
        "SELECT s_suppkey AS image, s_acctbal AS latitude, s_name AS model FROM supplier",
    ),
}
