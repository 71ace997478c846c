"""Log events derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import logs
from fieldspark.sources.logs import parse_logs
from workloads.inputs import table, with_sql

_NAMES = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "TRACE"]


def json_lines(spark, sf):
    """One JSON line per event; every tenth is cut in half."""
    e = table(spark, sf, "events")
    level = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
            level.alias("level"),
            F.col("user_id").cast("int").alias("pid"),
            F.concat(F.lit("u"), F.col("user_id")).alias("tool"),
            F.col("event_type").alias("msg"),
            F.col("props").alias("data"),
            F.col("event_id").cast("string").alias("session_id"),
        )
    )
    line = F.when(F.col("event_id") % 10 == 0, F.substring(body, 1, 40)).otherwise(body)
    return e.select(line.alias("value"))


def events(spark, sf):
    return parse_logs(json_lines(spark, sf))


EVENTS_SQL = """ev AS (SELECT event_id, CAST(event_id AS VARCHAR) AS session_id, ['DEBUG','INFO','WARNING','ERROR','CRITICAL','TRACE'][event_id%6+1] AS level,
 user_id AS pid, 'u' || user_id AS tool, event_type AS msg, props AS data, date_trunc('second', ts) AS ts FROM events WHERE event_id%10<>0)"""


def parsed_logs(spark, sf):
    return events(spark, sf).select("session_id", "level", "plugin", "pid", "tool", "class", "msg", "event_time")


def filter_logs(spark, sf):
    d = logs.filter_logs(events(spark, sf), text="CLICK", levels=["ERROR", "CRITICAL", "INFO"])
    return d.select("session_id", "level", "tool")


def filter_logs_regex(spark, sf):
    d = logs.filter_logs(events(spark, sf), text=r"u1[0-4] .*(click|view)", regex=True)
    return d.select("session_id", "tool")


def filter_logs_time(spark, sf):
    d = logs.filter_logs(events(spark, sf), start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")
    return d.select("session_id")


def order_logs(spark, sf):
    d = logs.order_logs(events(spark, sf), "level", "session_id")
    return d.select("session_id", "level")


def log_values(spark, sf):
    from fieldspark.operators.stats import distinct_values

    return distinct_values(events(spark, sf), "tool")


def latest_sessions(spark, sf):
    d = events(spark, sf).groupBy(F.col("tool").alias("file_name")).agg(F.max("event_time").alias("session_start"))
    return logs.latest_sessions(d, 25)


def expired_sessions(spark, sf):
    d = events(spark, sf).groupBy(F.col("tool").alias("file_name")).agg(F.max("event_time").alias("session_start"))
    return logs.expired_sessions(d, 25).select("file_name")


def error_counts(spark, sf):
    return logs.error_counts(events(spark, sf), "1 hour")


_SESS = "SELECT tool AS file_name, max(ts) AS session_start FROM ev GROUP BY 1"
REGISTRY = {
    "parsed_logs": (
        parsed_logs,
        with_sql(
            [EVENTS_SQL],
            "SELECT session_id, level, 'Unknown' AS plugin, pid, tool, 'UnknownClass' AS class, msg, ts AS event_time FROM ev",
        ),
    ),
    "filter_logs": (
        filter_logs,
        with_sql(
            [EVENTS_SQL],
            "SELECT session_id, level, tool FROM ev WHERE level IN ('ERROR','CRITICAL','INFO') AND contains(lower(msg || ' ' || data), 'click')",
        ),
    ),
    "filter_logs_regex": (
        filter_logs_regex,
        with_sql(
            [EVENTS_SQL],
            "SELECT session_id, tool FROM ev WHERE regexp_matches(lower(tool || ' UnknownClass ' || msg || ' ' || pid || ' Unknown ' || data), 'u1[0-4] .*(click|view)')",
        ),
    ),
    "filter_logs_time": (
        filter_logs_time,
        with_sql([EVENTS_SQL], "SELECT session_id FROM ev WHERE ts BETWEEN '2024-01-05'::TIMESTAMP AND '2024-01-20'::TIMESTAMP"),
    ),
    "order_logs": (
        order_logs,
        with_sql(
            [EVENTS_SQL],
            """SELECT session_id, level FROM ev ORDER BY CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 99 END, session_id""",
        ),
    ),
    "log_values": (log_values, with_sql([EVENTS_SQL], "SELECT DISTINCT tool FROM ev")),
    "latest_sessions": (
        latest_sessions,
        with_sql([EVENTS_SQL], f"SELECT * FROM ({_SESS}) ORDER BY session_start DESC, file_name DESC LIMIT 25"),
    ),
    "expired_sessions": (
        expired_sessions,
        with_sql(
            [EVENTS_SQL],
            f"SELECT file_name FROM (SELECT *, row_number() OVER (ORDER BY session_start DESC, file_name DESC) AS rn FROM ({_SESS})) WHERE rn > 25",
        ),
    ),
    "error_counts": (
        error_counts,
        with_sql(
            [EVENTS_SQL],
            "SELECT date_trunc('hour', ts) AS window_start, tool, level, count(*) AS errors FROM ev WHERE level IN ('ERROR','CRITICAL') GROUP BY ALL",
        ),
    ),
}
