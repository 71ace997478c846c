"""Log filters, order and sessions; the filters also work on a stream."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
_TEXT = ("ts", "level", "plugin", "tool", "class", "msg", "pid", "thread", "data")


def search_text(df: DataFrame) -> Column:
    """The nine searched fields in lower case, one blank between them."""
    have = set(df.columns)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in _TEXT]
    return F.lower(F.concat_ws(" ", *parts))


def filter_logs(
    df: DataFrame,
    text: str | None = None,
    regex: bool = False,
    levels: Iterable[str] | None = None,
    tools: Iterable[str] | None = None,
    classes: Iterable[str] | None = None,
    start=None,
    end=None,
    time: str = "event_time",
) -> DataFrame:
    """All given filters together.  A broken pattern filters nothing; rows without
    a time drop out once a time range is set."""
    out = df
    # Set and time filters first: they reach the file scan.
    for column, values in (("level", levels), ("tool", tools), ("class", classes)):
        chosen = list(values or [])
        if chosen:
            out = out.filter(F.col(column).isin(*chosen))
    if start is not None:
        out = out.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    if text:
        haystack = search_text(out)
        if not regex:
            out = out.filter(haystack.contains(text.lower()))
        elif _compiles(text):
            out = out.filter(haystack.rlike("(?i)" + text))
    return out


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def severity_rank(level: Column) -> Column:
    rank = F.lit(99)
    for name, i in LEVELS.items():
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def order_logs(df: DataFrame, by: str = "level", tie: str = "ts") -> DataFrame:
    """Sorted by a column; levels in order of severity, unknown ones last."""
    key = severity_rank(F.col("level")) if by == "level" else F.col(by)
    return df.orderBy(key, tie)


def latest_sessions(df: DataFrame, n: int, start: str = "session_start") -> DataFrame:
    """The n newest sessions."""
    return df.orderBy(F.desc_nulls_last(start), F.desc("file_name")).limit(n)


def expired_sessions(df: DataFrame, keep: int, start: str = "session_start") -> DataFrame:
    """Sessions beyond the newest ``keep``, the ones retention would remove."""
    newest = latest_sessions(df, keep, start).select("file_name")
    return df.join(newest, "file_name", "left_anti")


def sessions(logs: DataFrame) -> DataFrame:
    """One row per log file with its events, errors and time span."""
    keys = [c for c in ("file_name", "session_start", "session_pid", "session_name") if c in logs.columns]
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    )


def error_counts(df: DataFrame, width: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """Errors per tool, level and time window; the batch twin of the stream."""
    bad = df.filter(F.col("level").isin("ERROR", "CRITICAL"))
    g = bad.groupBy(F.window(time, width).alias("w"), "tool", "level").agg(F.count(F.lit(1)).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), "tool", "level", "errors")
