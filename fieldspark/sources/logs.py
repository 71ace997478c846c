"""JSON-lines logs: tolerant parsing, shared by batch and streaming reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "ts string, level string, plugin string, plugin_version string, session_id string, pid int, "
    "thread string, tool string, class string, code string, msg string, data string"
)
# What an absent field means.
DEFAULTS = {
    "level": "UNKNOWN",
    "plugin": "Unknown",
    "plugin_version": "unknown",
    "thread": "Unknown",
    "tool": "unknown_tool",
    "class": "UnknownClass",
    "msg": "",
    "data": "{}",
}
FILE_PATTERN = r"(?i)^[A-Za-z]+_(\d{8})_(\d{6})_pid(\d+)\.log$"


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events of JSON lines; blank, broken and half-written lines drop out."""
    parsed = F.from_json(
        F.trim(line), SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    others = [c for c in lines.columns if c != line]
    d = lines.withColumn("_e", parsed)
    d = d.filter(F.col("_e").isNotNull() & F.col("_e._corrupt").isNull() & F.trim(line).startswith("{"))
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    fields = []
    for n in names:
        c = F.col(f"_e.{n}")
        if n == "pid":
            c = F.coalesce(c, F.lit(0))
        elif n in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[n]))
        fields.append(c.alias(n))
    out = d.select(*others, *fields, F.trim(line).alias("raw_json"))
    return out.withColumn("event_time", event_time(F.col("ts")))


def event_time(ts: Column) -> Column:
    text = F.regexp_replace(ts, "Z$", "+00:00")
    return text.try_cast("timestamp")


def file_session(name: Column) -> dict[str, Column]:
    """Start time and process id from a log file name."""
    day, clock = F.regexp_extract(name, FILE_PATTERN, 1), F.regexp_extract(name, FILE_PATTERN, 2)
    pid = F.regexp_extract(name, FILE_PATTERN, 3)
    start = F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss"))
    return {
        "session_start": start,
        "session_pid": F.when(pid != "", pid.cast("int")),
        "session_name": F.when(
            start.isNotNull(),
            F.concat(F.date_format(start, "yyyy-MM-dd HH:mm:ss"), F.lit(" (PID "), pid, F.lit(")")),
        ).otherwise(name),
    }


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files of a folder with the session of each file."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_name").alias("file_name")
    )
    d = parse_logs(lines)
    return d.withColumns(file_session(F.col("file_name")))


def write_logs(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Append events as JSON lines in rolled files, which a file stream picks up."""
    df.write.mode("append").option("maxRecordsPerFile", max_records).json(path)
