"""Live log analytics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspark.sources.logs import parse_logs
from fieldspark.sources.ranges import appended_lines


def stream_logs(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int | None = None) -> DataFrame:
    """Events of the log files of a folder as a stream: new files and lines appended to known ones.

    A last line without its line feed waits until it is whole, a file cut short is read again from its beginning;
    the checkpoint remembers how far every file was read."""
    lines = appended_lines(spark, path, pattern, range_bytes)
    return parse_logs(lines.select("value", "file_name", "line_start"))


def error_windows(
    logs: DataFrame,
    width: str = "10 minutes",
    slide: str | None = None,
    gap: str | None = None,
    delay: str = "10 minutes",
    dedupe: list[str] | None = None,
) -> DataFrame:
    """Errors per tool and level in time windows, or in sessions split by ``gap``."""
    d = logs.filter(F.col("level").isin("ERROR", "CRITICAL")).withWatermark("event_time", delay)
    if dedupe:
        d = d.dropDuplicatesWithinWatermark(dedupe)
    w = F.session_window("event_time", gap) if gap else F.window("event_time", width, slide)
    g = d.groupBy(w.alias("w"), "tool", "level").agg(F.count(F.lit(1)).alias("errors"))
    return g.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "level", "errors"
    )


def start(
    df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Write a stream: on a timer when ``every`` is set, else what is there now, then stop."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start(sink)
