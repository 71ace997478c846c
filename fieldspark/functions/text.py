"""Scalar number, date and text helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of missing and infinite numbers.
_MISSING = ("", "none", "null", "nan")
_POS_INF = ("inf", "+inf", "infinity", "+infinity", "float('inf')", 'float("inf")')
_NEG_INF = ("-inf", "-infinity", "float('-inf')", 'float("-inf")')

# Accepted timestamp layouts, tried in this order.
CAPTURE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
    "yyyy:MM:dd HH:mm:ss",
    "yyyyMMddHHmm",
    "yyyyMMdd",
)
REPORT_FORMATS = CAPTURE_FORMATS[:4] + ("yyyy-MM-dd",)
TRACK_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm:ss",
    "yyyyMMddHHmmss",
    "yyyyMMdd_HHmmss",
)


def is_missing(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit("")))).isin(*_MISSING)


def present(col: Column) -> Column:
    """The value, or null where it counts as missing."""
    return F.when(~is_missing(col), col)


def parse_num(col: Column) -> Column:
    """Number from text, with the accepted spellings of infinity."""
    t = F.lower(F.trim(col.cast("string")))
    return (
        F.when(t.isin(*_POS_INF), float("inf"))
        .when(t.isin(*_NEG_INF), float("-inf"))
        .otherwise(t.try_cast("double"))
    )


def plain_num(col: Column) -> Column:
    """Number from text, "+" signs ignored; null where missing or not a number."""
    return F.replace(F.trim(col.cast("string")), F.lit("+"), F.lit("")).try_cast("double")


def finite(col: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    d = col.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def finite_num(col: Column) -> Column:
    n = parse_num(col)
    return F.when(finite(n), n)


def is_zero(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")).try_cast("double") == 0.0, F.lit(False))


def snake_case(col: Column) -> Column:
    spaced = F.regexp_replace(col, r"(?<!^)(?=[A-Z])", "_")
    merged = F.regexp_replace(F.regexp_replace(spaced, r"[ \-/]", "_"), "_+", "_")
    return F.lower(F.regexp_replace(merged, "^_+|_+$", ""))


def duration_text(seconds: Column, style: str = "clock") -> Column:
    """``clock``: hh:mm:ss or N/A; ``short``: 1h2m, 3m4s, 5s."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    if style == "clock":
        return F.when(s.isNull(), "N/A").otherwise(F.format_string("%02d:%02d:%02d", h, m, r))
    return (
        F.when(seconds <= 0, "0s")
        .when(h > 0, F.format_string("%dh%dm", h, m))
        .when(m > 0, F.format_string("%dm%ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def stage_text(seconds: Column) -> Column:
    """1h 02m 03.40s, 2m 03.40s or 3.40s; N/A for null."""
    h = F.floor(seconds / 3600).cast("int")
    m = F.floor(seconds % 3600 / 60).cast("int")
    s = seconds % 60
    return (
        F.when(seconds.isNull(), "N/A")
        .when(h > 0, F.format_string("%dh %02dm %05.2fs", h, m, s))
        .when(m > 0, F.format_string("%dm %05.2fs", m, s))
        .otherwise(F.format_string("%.2fs", s))
    )


def shutter_text(seconds: Column) -> Column:
    denom = F.bround(1.0 / seconds).cast("bigint")
    return (
        F.when(seconds.isNull() | (seconds <= 0), "N/A")
        .when(seconds >= 1, F.format_string("%.2fs", seconds))
        .when(denom <= 0, "N/A")
        .otherwise(F.format_string("1/%ds", denom))
    )


def bytes_text(n: Column) -> Column:
    n = n.cast("double")
    out = F.format_string("%.1fTB", n / float(1024**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        scaled = n / float(1024**power)
        out = F.when(scaled < 1024, F.format_string(f"%.1f{unit}", scaled)).otherwise(out)
    return out


def num_text(value: Column) -> Column:
    """Integers without decimals, others with at most four, infinities by name."""
    v = value.cast("double")
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), "0+$", ""), r"\.$", "")
    return (
        F.when(v == float("inf"), "inf")
        .when(v == float("-inf"), "-inf")
        .when(v == F.floor(v), v.cast("decimal(38,0)").cast("string"))
        .otherwise(trimmed)
    )


def parse_ts(col: Column, formats: tuple[str, ...] = REPORT_FORMATS) -> Column:
    """First layout that fits, null if none does."""
    text = F.trim(col.cast("string"))
    text = F.regexp_replace(text, "Z$", "+00:00")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def track_seconds(col: Column, data_type: str) -> Column:
    """Epoch seconds of a track timestamp given as timestamp, number or text."""
    if data_type == "timestamp" or data_type == "timestamp_ntz":
        return F.unix_micros(col.cast("timestamp")) / 1e6
    if data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or data_type.startswith(
        "decimal"
    ):
        return col.cast("double")
    text = F.trim(col.cast("string"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    parsed = F.coalesce(
        parse_ts(text, TRACK_FORMATS),
        F.when(F.length(digits) == 14, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))),
    )
    return F.coalesce(F.unix_micros(parsed) / 1e6, text.try_cast("double"))


def safe_path(col: Column) -> Column:
    """A path component: characters file systems reject become one space."""
    spaced = F.regexp_replace(F.coalesce(col, F.lit("")), r'[<>:"/\\|?*]+', " ")
    return F.regexp_replace(F.trim(F.regexp_replace(spaced, r"\s+", " ")), r"\.+$", "")


def safe_field(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9A-Za-z_]", "_")


def printable(col: Column) -> Column:
    """Text without control characters (tabs stay); null when nothing is left."""
    cleaned = F.trim(F.regexp_replace(col, r"[\p{Cntrl}&&[^\t]]", ""))
    return F.when(cleaned != "", cleaned)


def short_msg(col: Column, n: int = 100) -> Column:
    text = F.replace(col, F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(
        text
    )


def file_uri(path: Column) -> Column:
    return F.when(is_missing(path), "").otherwise(
        F.concat(F.lit("file:///"), F.replace(path, F.lit("\\"), F.lit("/")))
    )


def natural_key(col: Column) -> Column:
    """Text that sorts as humans expect: digit runs compare as numbers, nulls first."""
    chunks = F.regexp_extract_all(col.cast("string"), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    # A number's length in front of it, without leading zeros, makes numbers of any length compare as text.
    bare = lambda c: F.ltrim(c, F.lit("0"))
    sized = F.transform(
        chunks,
        lambda c: F.when(
            c.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(c)).cast("string"), 10, "0"), bare(c))
        ).otherwise(c),
    )
    return F.coalesce(F.concat(F.lit("1"), F.array_join(sized, "")), F.lit("0"))


def id_key(col: Column) -> Column:
    """Sort key of a track id: numbers first in numeric order, then text."""
    text = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    number = F.trim(col.cast("string")).try_cast("double")
    return F.struct(
        number.isNull().alias("is_text"),
        number.alias("number"),
        F.when(number.isNull(), text).alias("text"),
    )
