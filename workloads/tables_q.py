"""Statistics, field calculators, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import angles, geo, text
from fieldspark.operators import fields, filters, relate, stats
from workloads.inputs import POINTS_A_SQL, POINTS_B_SQL, points_a, points_b, table, with_sql

R = 6


def _round(df, skip=(), digits=R):
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


NO_MODE = [s for s in stats.STATISTICS if s != "mode"]


def _stats_round(df):
    return _round(df.withColumn("sum", F.round("sum", 2)), digits=4)


def attribute_statistics(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _stats_round(stats.attribute_statistics(li, stats=NO_MODE))


def _stats_sql(group: str = "", names=("l_quantity", "l_extendedprice", "l_discount", "l_tax")):
    parts = []
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    for n in names:
        v = f"CAST({n} AS DOUBLE)"
        m = f"avg({v})"
        part = f"PARTITION BY {group}" if group else ""
        parts.append(
            f"""SELECT {head}'{n}' AS field, count({n}) AS count,
 round(avg(abs({v})),4) AS mean_abs, round({m},4) AS mean, round(stddev_pop({v}),4) AS std_pop,
 round(stddev_samp({v}),4) AS std_samp, round(min({v}),4) AS min, round(max({v}),4) AS max,
 round(max({v})-min({v}),4) AS range, round(quantile_cont({v},0.5),4) AS median,
 round(quantile_cont({v},0.05),4) AS p5, round(quantile_cont({v},0.95),4) AS p95,
 round(var_pop({v}),4) AS variance, round(sum({v}),2) AS sum, round(stddev_pop({v})/{m},4) AS cv,
 round(avg(pow({v}-mu,3))/pow(stddev_pop({v}),3),4) AS skew, round(kurtosis_pop({v}),4) AS kurt
 FROM (SELECT *, avg(CAST({n} AS DOUBLE)) OVER ({part}) AS mu FROM lineitem){tail}"""
        )
    return "\nUNION ALL\n".join(parts)


def attribute_statistics_grouped(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return _stats_round(stats.attribute_statistics(li, stats=NO_MODE, group_by=["l_returnflag"]))


def attribute_mode(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return stats.attribute_statistics(li, stats=["mode"])


MODE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS field, count, mode FROM (
 SELECT CAST({n} AS DOUBLE) AS mode, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS count,
 row_number() OVER (ORDER BY count(*) DESC, {n}) AS rn FROM lineitem WHERE {n} IS NOT NULL GROUP BY {n}) WHERE rn = 1"""
    for n in ("l_quantity", "l_discount", "l_tax")
)


def percentile_stats(spark, sf):
    return stats.percentile_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


def sketch_percentiles(spark, sf):
    """Percentiles from daily sketches that are merged, and whether their true ranks are within the stated error."""
    from fieldspark.plans import quantiles

    li = table(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", F.col("l_extendedprice").cast("double").alias("price"))
    wanted = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    daily = quantiles.sketches(li, ["l_returnflag", "l_shipdate"], "price", 1024)
    whole = quantiles.quantiles_of(quantiles.merge_sketches(daily, ["l_returnflag"], 1024), ["l_returnflag"], wanted)
    # One row a flag against all rows.
    ranked = li.join(F.broadcast(whole), "l_returnflag").groupBy("l_returnflag", "count").agg(
        *[F.avg((F.col("price") <= F.col(n)).cast("double")).alias(n) for n in wanted]
    )
    error = quantiles.rank_error(1024)
    return ranked.select("l_returnflag", "count", *[(F.abs(F.col(n) - q) <= error + 1 / F.col("count")).alias(n) for n, q in wanted.items()])


PERCENTILE_SQL = """WITH v AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, count(*) AS count, round(avg(x),2) AS mean,
 round(max(CASE WHEN i = CAST(floor(0.05*(n-1)) AS BIGINT) THEN x END),2) AS p5,
 round(max(CASE WHEN i = CAST(floor(0.95*(n-1)) AS BIGINT) THEN x END),2) AS p95,
 round(max(CASE WHEN i = CAST(floor(0.95*(n-1)) AS BIGINT) THEN x END)
     - max(CASE WHEN i = CAST(floor(0.05*(n-1)) AS BIGINT) THEN x END),2) AS range
FROM v GROUP BY l_returnflag"""


def difference_fields(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    return fields.difference_fields(li, "l_quantity", exclude=["l_orderkey", "l_linenumber"])


DIFF_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
 round(l_discount - l_quantity, 2) AS diff_l_discount, round(l_tax - l_quantity, 2) AS diff_l_tax
FROM lineitem"""


def point_xy(spark, sf):
    return fields.point_xy(points_a(spark, sf)).select("fid", "x", "y")


def field_projection(spark, sf):
    """Reorder, drop and rename fields."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = s.withColumnsRenamed({"s_name": "timestamp", "s_suppkey": "Zid", "s_nationkey": "area"})
    return fields.sort_columns(fields.drop_kml_fields(s))


def copy_attributes(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.lit("x").alias("n_name")
    )
    return fields.copy_attributes(s, n, on_conflict="rename", key="n_nationkey")


def project_outputs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    seg = o.withColumns({"shot_id": F.col("o_orderkey").cast("string"), "score": F.lit(1), "extra": F.lit(2)})
    return fields.project_outputs(seg, ["o_orderkey", "o_orderstatus", "score"], ["score"])


def first_present(spark, sf):
    e = table(spark, sf, "events")
    blank = F.when(F.col("event_id") % 3 == 0, "nan").when(F.col("event_id") % 3 == 1, " ").otherwise(
        F.col("event_type")
    )
    return e.select("event_id", fields.first_present(blank, F.col("props")).alias("first_value"))


def prefix_ids(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % 4).cast("string").alias("shot_id")
    )
    return fields.prefix_ids(c, "c_nationkey", "c_custkey")


PREFIX_SQL = """WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS i
 FROM customer GROUP BY c_nationkey)
SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE
 chr(CAST(65 + i % 26 AS INTEGER)) || CASE WHEN i < 26 THEN '' ELSE CAST(i // 26 AS VARCHAR) END
 || CAST(c_custkey % 4 AS VARCHAR) END AS shot_id FROM customer JOIN g USING (c_nationkey)"""


def only_ids(spark, sf):
    big = table(spark, sf, "orders").filter(F.col("o_totalprice") > 200000).select(
        F.col("o_custkey").alias("c_custkey")
    )
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return filters.only_ids(c, big, "c_custkey")


def finite_values(spark, sf):
    e = table(spark, sf, "events").withColumn(
        "v",
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 5 == 1, F.lit(float("inf")))
        .otherwise(F.col("value")),
    )
    return e.filter(text.finite(F.col("v"))).select("event_id", "v")


def lines_between(spark, sf):
    d = relate.lines_between(points_a(spark, sf), points_b(spark, sf), "k", "k")
    return d.select("group_key", "feature_a", "feature_b", F.round("distance", R).alias("distance"))


BETWEEN_SQL = with_sql(
    [POINTS_A_SQL, POINTS_B_SQL],
    """SELECT CAST(pa.k AS VARCHAR) AS group_key, pa.fid AS feature_a, pb.fid AS feature_b,
 round(sqrt((pb.x-pa.x)*(pb.x-pa.x)+(pb.y-pa.y)*(pb.y-pa.y)),6) AS distance
FROM pa JOIN pb ON CAST(pa.k AS VARCHAR) = CAST(pb.k AS VARCHAR)""",
)


def lines_within(spark, sf):
    d = relate.lines_within(points_b(spark, sf), "k")
    return d.select("group_key", "feature_a", "feature_b", F.round("distance", R).alias("distance"))


WITHIN_SQL = with_sql(
    [POINTS_B_SQL],
    """SELECT * FROM (SELECT CAST(k AS VARCHAR) AS group_key, fid AS feature_a,
 lead(fid) OVER w AS feature_b,
 round(sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x)+(lead(y) OVER w - y)*(lead(y) OVER w - y)),6) AS distance
 FROM pb WINDOW w AS (PARTITION BY k ORDER BY fid)) WHERE feature_b IS NOT NULL""",
)


def only_missing(spark, sf):
    p = table(spark, sf, "pages").select(F.col("url").alias("path"))
    loaded = p.filter(F.length("path") % 2 == 0).select(F.concat("path", F.lit("|layer=1")).alias("path"))
    return relate.only_missing(p, loaded)


MISSING_SQL = """WITH p AS (SELECT url AS path FROM pages)
SELECT path FROM p WHERE lower(regexp_replace(replace(path, '\\', '/'), '\\|.*$', '')) NOT IN
 (SELECT lower(regexp_replace(replace(path, '\\', '/'), '\\|.*$', '')) FROM p WHERE length(path) % 2 = 0)"""


def backfill(spark, sf):
    o = table(spark, sf, "orders")
    left = o.select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("name"),
    )
    c = table(spark, sf, "customer")
    # Two source rows for each key, in an order that their values do not have.
    src = c.select("c_custkey", F.col("c_name").alias("name"), F.lit(2).alias("pos")).unionByName(
        c.select("c_custkey", F.concat(F.lit("z"), F.col("c_name")).alias("name"), F.lit(1).alias("pos"))
    )
    return relate.backfill(left, src, ["c_custkey"], order="pos")


BACKFILL_SQL = """SELECT o_orderkey, o_custkey AS c_custkey, coalesce(nullif(
 CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), c_name) AS name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def match_by_rank(spark, sf):
    a = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("seq"), "o_orderkey")
    b = table(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("seq"), "c_custkey")
    return relate.match_by_rank(a, b, ["seq"], "o_orderkey", "c_custkey")


RANK_SQL = """WITH a AS (SELECT o_orderkey % 100 AS seq, o_orderkey,
 row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) AS r FROM orders),
b AS (SELECT c_custkey % 100 AS seq, c_custkey,
 row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey) AS r FROM customer)
SELECT a.seq, o_orderkey, c_custkey FROM a LEFT JOIN b ON a.seq = b.seq AND a.r = b.r"""


def merge_layers(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")
    )
    return relate.merge_layers(s, c)


MERGE_SQL = """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, CAST(NULL AS BIGINT) AS n FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_nationkey FROM customer"""


def distinct_ordered(spark, sf):
    return stats.distinct_ordered(table(spark, sf, "events"), ["event_type", "user_id"], "event_id")


def drop_duplicate_geometries(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"),
        geo.wkt_point(geo.point(F.col("l_quantity"), F.col("l_discount"))).alias("geom"),
    )
    return relate.drop_duplicate_geometries(li, order="fid").select("fid")


DEDUP_SQL = """SELECT min(l_orderkey * 8 + l_linenumber) AS fid FROM lineitem GROUP BY l_quantity, l_discount"""


def profile_types(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("a"),
        F.col("value").cast("string").alias("b"),
        "event_type",
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("false").alias("c"),
        (F.col("event_id") + 3000000000).cast("string").alias("d"),
    )
    return stats.profile_types(e)


PROFILE_SQL = """SELECT * FROM (VALUES ('a','int'),('b','double'),('event_type','string'),('c','bool'),('d','string')) t(field, type)
WHERE (SELECT count(*) FROM events) > 0"""


def duplicates(spark, sf):
    return stats.duplicates(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


def distinct_values(spark, sf):
    return stats.distinct_values(table(spark, sf, "events"), "event_type")


def visible_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", F.lit(0.0).alias("zeros"), F.lit(None).cast("double").alias("nulls")
    )
    return stats.visible_columns(li, li.columns)


VISIBLE_SQL = """SELECT 'l_quantity' AS "column", max(l_quantity) <> 0 AS visible FROM lineitem
UNION ALL SELECT 'l_discount', max(l_discount) <> 0 FROM lineitem
UNION ALL SELECT 'zeros', false UNION ALL SELECT 'nulls', false"""


def group_by_dir(spark, sf):
    return stats.group_by_dir(table(spark, sf, "pages"), "url")


def files_by_dir(spark, sf):
    return stats.files_by_dir(table(spark, sf, "pages"), "url")


DIR_SQL = "SELECT regexp_replace(url, '/[^/]*$', '') AS directory, count(*) AS file_count FROM pages GROUP BY 1"
FILES_SQL = "SELECT regexp_replace(url, '/[^/]*$', '') AS directory, regexp_extract(url, '([^/]*)$', 1) AS file FROM pages"


def update_by_map(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return fields.update_by_map(o, "o_orderstatus", {"F": "filled", "O": "open"})


def circular_means(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("az", (F.col("l_partkey") * 7 % 360).cast("double"))
    az, q = F.col("az"), F.col("l_quantity")
    out = li.groupBy("l_suppkey").agg(
        angles.circular_mean(az).alias("circular_mean"),
        angles.circular_mean_w(az, q).alias("circular_mean_w"),
        angles.circular_var(az).alias("circular_var"),
        angles.axial_mean(az).alias("axial_mean"),
        angles.axial_mean_w(az, q).alias("axial_mean_w"),
        angles.axial_var(az).alias("axial_var"),
    )
    return _round(out)


def _pmod(e, m):
    return f"((({e}) % {m}) + {m}) % {m}"


_CM = "degrees(atan2(sum(sin(radians({a})*{w})), sum(cos(radians({a})*{w}))))"
CIRCULAR_SQL = f"""WITH l AS (SELECT *, CAST(l_partkey * 7 % 360 AS DOUBLE) AS az FROM lineitem)
SELECT l_suppkey,
 round({_pmod("degrees(atan2(sum(sin(radians(az))), sum(cos(radians(az)))))", 360)},6) AS circular_mean,
 round({_pmod("degrees(atan2(sum(sin(radians(az))*l_quantity), sum(cos(radians(az))*l_quantity)))", 360)},6) AS circular_mean_w,
 round(1 - sqrt(pow(avg(sin(radians(az))),2) + pow(avg(cos(radians(az))),2)),6) AS circular_var,
 round({_pmod(_pmod("degrees(atan2(sum(sin(radians(2*az))), sum(cos(radians(2*az)))))", 360) + " / 2", 180)},6) AS axial_mean,
 round({_pmod(_pmod("degrees(atan2(sum(sin(radians(2*az))*l_quantity), sum(cos(radians(2*az))*l_quantity)))", 360) + " / 2", 180)},6) AS axial_mean_w,
 round(1 - sqrt(pow(avg(sin(radians(2*az))),2) + pow(avg(cos(radians(2*az))),2)),6) AS axial_var
FROM l GROUP BY l_suppkey"""


def angle_utilities(spark, sf):
    li = table(spark, sf, "lineitem")
    a = (F.col("l_partkey") * 7 % 360).cast("double")
    b = (F.col("l_suppkey") * 11 % 360).cast("double")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        angles.angular_diff(a, b).alias("min_angle"),
        angles.axial_diff(a, b).alias("axial_diff"),
        angles.bearing_180(a).alias("bearing"),
    )


ANGLE_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey*7%360 AS DOUBLE) AS a,
 CAST(l_suppkey*11%360 AS DOUBLE) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, least(abs(a-b)%360, 360-abs(a-b)%360) AS min_angle,
 least(abs(a-b)%180, 180-abs(a-b)%180) AS axial_diff,
 CASE WHEN a > 180 THEN a - 180 ELSE a END AS bearing FROM l"""


def haversine_bearing(spark, sf):
    c = table(spark, sf, "customer")
    lat1, lon1 = F.col("c_acctbal") / 200, F.col("c_custkey") % 180
    lat2, lon2 = F.col("c_acctbal") / 300, F.col("c_nationkey") * 5
    return c.select(
        "c_custkey",
        F.round(geo.haversine(lat1, lon1, lat2, lon2), 3).alias("distance"),
        F.round(geo.bearing(lat1, lon1, lat2, lon2), 5).alias("bearing"),
    )


HAVERSINE_SQL = f"""WITH p AS (SELECT c_custkey, radians(c_acctbal/200) AS a, radians(c_acctbal/300) AS b,
 radians(c_nationkey*5 - c_custkey%180) AS dl FROM customer),
q AS (SELECT *, pow(sin((b-a)/2),2) + cos(a)*cos(b)*pow(sin(dl/2),2) AS h FROM p)
SELECT c_custkey, round(2*6371000.0*atan2(sqrt(h), sqrt(1-h)),3) AS distance,
 round({_pmod("degrees(atan2(sin(dl)*cos(b), cos(a)*sin(b)-sin(a)*cos(b)*cos(dl)))", 360)},5) AS bearing FROM q"""


def map_center(spark, sf):
    from fieldspark.operators.geometry import map_center as center

    c = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal") / 200).alias("lat"),
        F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal") / 100).alias("lon"),
    )
    return _round(center(c, "lat", "lon"))


CENTER_SQL = """SELECT round(avg(c_acctbal/200),6) AS lat, round(avg(c_acctbal/100),6) AS lon FROM customer
WHERE c_custkey % 7 <> 0 AND NOT (abs(c_acctbal/200) < 1e-6 AND abs(c_acctbal/100) < 1e-6)"""


def scalar_text(spark, sf):
    li = table(spark, sf, "lineitem")
    secs = F.col("l_partkey") * 13
    return li.select(
        "l_orderkey",
        "l_linenumber",
        text.duration_text(secs).alias("clock"),
        text.num_text(F.col("l_discount")).alias("num"),
        text.num_text(F.col("l_quantity")).alias("whole"),
        text.shutter_text(F.col("l_discount")).alias("shutter"),
    )


SCALAR_SQL = """SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d', (l_partkey*13)//3600, (l_partkey*13)%3600//60, (l_partkey*13)%60) AS clock,
 CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR)
  ELSE rtrim(rtrim(printf('%.4f', l_discount), '0'), '.') END AS num,
 CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  ELSE rtrim(rtrim(printf('%.4f', l_quantity), '0'), '.') END AS whole,
 CASE WHEN l_discount <= 0 THEN 'N/A' ELSE '1/' || CAST(CAST(round_even(1/l_discount, 0) AS BIGINT) AS VARCHAR) || 's' END AS shutter
FROM lineitem"""


def text_cleanup(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        text.short_msg(F.col("text")).alias("short"),
        text.safe_field(F.col("source")).alias("field"),
        text.file_uri(F.concat(F.lit("C:\\data\\"), F.col("source"))).alias("uri"),
    )


CLEANUP_SQL = r"""SELECT doc_id, CASE WHEN length(text) > 100 THEN replace(text[1:97], chr(10), ' ') || '...' ELSE replace(text, chr(10), ' ') END AS short,
 regexp_replace(source, '[^0-9A-Za-z_]', '_', 'g') AS field,
 'file:///C:/data/' || replace(source, '\', '/') AS uri FROM documents"""


def natural_order(spark, sf):
    """Names with one and with two runs of digits, one of them longer than any number type."""
    name = F.concat(F.lit("A"), F.col("p_partkey"), F.lit("x"), F.repeat(F.lit("7"), 30), F.col("p_size"))
    p = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return p.select("p_partkey", text.natural_key(F.col("name")).alias("sort_key"))


NATURAL_SQL = """SELECT p_partkey, '1A' || printf('%010d', length(a)) || a || 'x' || printf('%010d', length(b)) || b AS sort_key
FROM (SELECT p_partkey, ltrim(CAST(p_partkey AS VARCHAR), '0') AS a, repeat('7', 30) || p_size AS b FROM part)"""


def dms_to_decimal(spark, sf):
    from fieldspark.functions.crs import dms_to_decimal as dms

    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    parts = F.array(
        (k % 90).cast("string"),
        F.concat((k % 60).cast("string"), F.lit("/1")),
        F.concat((k * 7 % 6000).cast("string"), F.lit("/100")),
    )
    return c.select("c_custkey", F.round(dms(parts, F.when(k % 2 == 0, "S").otherwise("N")), 9).alias("deg"))


DMS_SQL = """SELECT c_custkey, round((CASE WHEN c_custkey%2=0 THEN -1 ELSE 1 END) *
 (c_custkey%90 + (c_custkey%60)/60 + (c_custkey*7%6000)/100/3600), 9) AS deg FROM customer"""


def coordinate_info(spark, sf):
    from fieldspark.functions.crs import coordinate_info as info

    c = table(spark, sf, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 60).alias("px"),
        (F.col("c_acctbal") / 150).alias("py"),
    )
    return info(c, "px", "py").select(
        "c_custkey", "zone", "zone_letter", "hemisphere", "epsg",
    )


COORD_SQL = """WITH p AS (SELECT c_custkey, c_acctbal/60 AS x, c_acctbal/150 AS y FROM customer)
SELECT c_custkey, CAST(floor((x+180)/6) AS INTEGER)+1 AS zone,
 'CDEFGHJKLMNPQRSTUVWX'[CAST(floor((y+80)/8) AS INTEGER)+1] AS zone_letter,
 CASE WHEN y < 0 THEN 'Sul' ELSE 'Norte' END AS hemisphere,
 (CASE WHEN y < 0 THEN 31960 ELSE 31954 END) + CAST(floor((x+180)/6) AS INTEGER)+1 AS epsg FROM p"""

REGISTRY = {
    "attribute_statistics": (attribute_statistics, _stats_sql()),
    "attribute_statistics_grouped": (
        attribute_statistics_grouped,
        _stats_sql("l_returnflag", ("l_quantity", "l_discount")),
    ),
    "attribute_mode": (attribute_mode, MODE_SQL),
    "percentile_stats": (percentile_stats, PERCENTILE_SQL),
    "sketch_percentiles": (
        sketch_percentiles,
        "SELECT l_returnflag, count(*) AS count, TRUE AS p5, TRUE AS p50, TRUE AS p95 FROM lineitem GROUP BY l_returnflag",
    ),
    "difference_fields": (difference_fields, DIFF_SQL),
    "point_xy": (
        point_xy,
        with_sql([POINTS_A_SQL], "SELECT fid, round(x,8) AS x, round(y,8) AS y FROM pa"),
    ),
    "field_projection": (
        field_projection,
        "SELECT s_nationkey AS area, s_suppkey AS Zid FROM supplier",
    ),
    "copy_attributes": (
        copy_attributes,
        """SELECT s_suppkey, s_nationkey AS n_nationkey, 'x' AS n_name, nation.n_name AS n_name_1, n_regionkey
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "project_outputs": (
        project_outputs,
        "SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS shot_id, 1 AS score FROM orders",
    ),
    "first_present": (
        first_present,
        "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_type ELSE props END AS first_value FROM events",
    ),
    "prefix_ids": (prefix_ids, PREFIX_SQL),
    "only_ids": (
        only_ids,
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    ),
    "finite_values": (finite_values, "SELECT event_id, value AS v FROM events WHERE event_id % 5 > 1"),
    "lines_between": (lines_between, BETWEEN_SQL),
    "lines_within": (lines_within, WITHIN_SQL),
    "only_missing": (only_missing, MISSING_SQL),
    "backfill": (backfill, BACKFILL_SQL),
    "match_by_rank": (match_by_rank, RANK_SQL),
    "merge_layers": (merge_layers, MERGE_SQL),
    "distinct_ordered": (
        distinct_ordered,
        "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    ),
    "drop_duplicate_geometries": (drop_duplicate_geometries, DEDUP_SQL),
    "profile_types": (profile_types, PROFILE_SQL),
    "duplicates": (
        duplicates,
        "SELECT l_partkey, l_suppkey, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "distinct_values": (distinct_values, "SELECT DISTINCT event_type FROM events"),
    "visible_columns": (visible_columns, VISIBLE_SQL),
    "group_by_dir": (group_by_dir, DIR_SQL),
    "files_by_dir": (files_by_dir, FILES_SQL),
    "update_by_map": (
        update_by_map,
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    ),
    "circular_means": (circular_means, CIRCULAR_SQL),
    "angle_utilities": (angle_utilities, ANGLE_SQL),
    "haversine_bearing": (haversine_bearing, HAVERSINE_SQL),
    "map_center": (map_center, CENTER_SQL),
    "scalar_text": (scalar_text, SCALAR_SQL),
    "text_cleanup": (text_cleanup, CLEANUP_SQL),
    "natural_order": (natural_order, NATURAL_SQL),
    "dms_to_decimal": (dms_to_decimal, DMS_SQL),
    "coordinate_info": (coordinate_info, COORD_SQL),
}
