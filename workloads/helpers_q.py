"""Small column helpers over the driver's tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import crs, text
from fieldspark.operators import filters, report
from workloads.inputs import table


def snake_case(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("Order Priority/Of-"), F.col("o_orderpriority"), F.lit("AbcX__"))
    return o.select("o_orderkey", text.snake_case(name).alias("name"))


SNAKE_SQL = r"""SELECT o_orderkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 'Order Priority/Of-' || o_orderpriority || 'AbcX__', '([A-Z])', '_\1', 'g'), '[ \-/]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM orders"""


def bytes_text(spark, sf):
    """Odd sizes from bytes to terabytes."""
    o = table(spark, sf, "orders")
    n = (F.col("o_orderkey") * 2 + 1) * F.pow(F.lit(31.0), F.col("o_orderkey") % 8)
    return o.select("o_orderkey", text.bytes_text(n).alias("size"))


BYTES_SQL = """SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.1fB', n) WHEN n < 1024.0**2 THEN printf('%.1fKB', n / 1024)
 WHEN n < 1024.0**3 THEN printf('%.1fMB', n / 1024.0**2) WHEN n < 1024.0**4 THEN printf('%.1fGB', n / 1024.0**3)
 ELSE printf('%.1fTB', n / 1024.0**4) END AS size FROM (SELECT o_orderkey, (o_orderkey * 2 + 1) * pow(31.0, o_orderkey % 8) AS n FROM orders)"""


def printable(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.printable(F.concat(F.lit("\x01 a\tb\x7f"), "text")).cast("binary")).alias("digest"))


PRINTABLE_SQL = r"""SELECT doc_id, md5(trim(regexp_replace(chr(1) || ' a' || chr(9) || 'b' || chr(127) || text, '[\x00-\x08\x0A-\x1F\x7F]', '', 'g'))) AS digest
FROM documents"""


def parse_num(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, "Infinity").when(k == 1, " -INF ").when(k == 2, "float('inf')").when(k == 3, "abc").when(k == 4, "")
        .when(k == 5, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5 "))).when(k == 6, "1e3")
    )
    n = text.parse_num(raw)
    return e.select("event_id", n.alias("number"), text.finite(n).alias("is_finite"), text.finite_num(raw).alias("finite_number"))


PARSE_SQL = """SELECT event_id, n AS number, n IS NOT NULL AND abs(n) < 'inf'::DOUBLE AS is_finite, CASE WHEN abs(n) < 'inf'::DOUBLE THEN n END AS finite_number
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE
 WHEN 5 THEN event_id + 0.5 WHEN 6 THEN 1000 END AS n FROM events)"""


def id_order(spark, sf):
    """Places of mixed ids: numbers by value, then texts without regard to case."""
    from pyspark.sql import Window

    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" Bx"), k)).when(k % 3 == 1, F.concat(F.lit("a"), k)).otherwise(k.cast("string"))
    w = Window.partitionBy("c_nationkey").orderBy(text.id_key(raw), "c_custkey")
    return c.select("c_custkey", F.row_number().over(w).alias("place"))


ID_SQL = """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY TRY_CAST(id AS DOUBLE) IS NOT NULL DESC,
 TRY_CAST(id AS DOUBLE), lower(trim(id)), c_custkey) AS place
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN ' Bx' || c_custkey WHEN 1 THEN 'a' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer)"""


def extent_overlap(spark, sf):
    """Boxes of line items against a box of their order."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    u, v = F.col("o_custkey") % 100, F.col("o_orderkey") % 100
    a = {"xmin": x, "ymin": y, "xmax": x + F.col("l_quantity"), "ymax": y + F.col("l_quantity")}
    b = {"xmin": u, "ymin": v, "xmax": u + 10, "ymax": v + 20}
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.filter(filters.extent_overlap(a, b)).select("l_orderkey", "l_linenumber")


EXTENT_SQL = """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey % 100 <= o_custkey % 100 + 10 AND o_custkey % 100 <= l_partkey % 100 + l_quantity
 AND l_suppkey % 100 <= o_orderkey % 100 + 20 AND o_orderkey % 100 <= l_suppkey % 100 + l_quantity"""


def footprint_candidates(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    some = lambda n: F.when(k % n != 0, F.col("value"))
    d = e.select(
        "event_id",
        (k % 2 == 0).cast("string").alias("HasExifGps"),
        F.when(k % 5 != 0, "OK").otherwise("BAD").alias("QualityFlag"),
        some(3).alias("Lat"),
        F.lit(1.0).alias("GpsLatitude"),
        some(7).alias("Lon"),
        some(11).alias("GimbalYawDegree"),
        some(13).alias("GimbalPitchDegree"),
        F.col("value").alias("GimbalRollDegree"),
        F.when(k % 17 == 0, "0").when(k % 19 == 0, "high").otherwise("+12.5").alias("RelativeAltitude"),
    )
    return filters.footprint_candidates(d).select("event_id")


FOOTPRINT_SQL = """SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0
AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND value IS NOT NULL AND event_id % 17 <> 0 AND event_id % 19 <> 0"""


def estimated_area(spark, sf):
    li = table(spark, sf, "lineitem")
    area = report.estimated_area(F.col("l_quantity") - 3, F.col("l_discount") * 1000, F.lit(5472.0), F.lit(3648.0), F.col("l_linenumber"))
    flights = li.select("l_orderkey", area.alias("estimated_area_ha"))
    per = flights.groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.round(F.sum("estimated_area_ha"), 3).alias("area"))
    return per.crossJoin(report.total_area(flights).select(F.round("total_area_ha", 0).alias("total")))


AREA_SQL = """WITH f AS (SELECT l_orderkey, CASE WHEN l_quantity > 3 THEN 5472 * ((l_quantity - 3) / 100) * 3648 * ((l_quantity - 3) / 100)
 * (1 - l_discount * 10) * (1 - l_discount * 10) * l_linenumber / 10000 END AS a FROM lineitem)
SELECT l_orderkey % 100 AS part, round(sum(a), 3) AS area, (SELECT round(sum(a), 0) FROM f) AS total FROM f GROUP BY 1"""


def geographic(spark, sf):
    """Suppliers whose coordinate system is geographic, by a code from their key."""
    s = table(spark, sf, "supplier")
    codes = [4326, 4674, 32722, 31982, 3857]
    flags = F.array(*[F.lit(crs.is_geographic(c)) for c in codes])
    k = (F.col("s_suppkey") % len(codes)).cast("int")
    return s.select("s_suppkey", F.get(flags, k).alias("geographic"))


GEOGRAPHIC_SQL = "SELECT s_suppkey, s_suppkey % 5 < 2 AS geographic FROM supplier"


def duration_styles(spark, sf):
    o = table(spark, sf, "orders")
    s = F.col("o_orderkey") % 9000 - 5
    return o.select("o_orderkey", text.duration_text(s, "short").alias("short"), text.stage_text(s.cast("double") + 5.25).alias("stage"))


DURATION_SQL = """SELECT o_orderkey, CASE WHEN s <= 0 THEN '0s' WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm'
 WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS short,
 CASE WHEN t >= 3600 THEN printf('%dh %02dm %05.2fs', floor(t / 3600)::INT, floor(t % 3600 / 60)::INT, t % 60)
 WHEN t >= 60 THEN printf('%dm %05.2fs', floor(t / 60)::INT, t % 60) ELSE printf('%.2fs', t) END AS stage
FROM (SELECT o_orderkey, o_orderkey % 9000 - 5 AS s, o_orderkey % 9000 + 0.25::DOUBLE AS t FROM orders)"""

REGISTRY = {
    "snake_case": (snake_case, SNAKE_SQL),
    "bytes_text": (bytes_text, BYTES_SQL),
    "printable": (printable, PRINTABLE_SQL),
    "parse_num": (parse_num, PARSE_SQL),
    "id_order": (id_order, ID_SQL),
    "extent_overlap": (extent_overlap, EXTENT_SQL),
    "footprint_candidates": (footprint_candidates, FOOTPRINT_SQL),
    "estimated_area": (estimated_area, AREA_SQL),
    "geographic": (geographic, GEOGRAPHIC_SQL),
    "duration_styles": (duration_styles, DURATION_SQL),
}
