"""Raster algebra, resampling, sampling and clipping on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.operators import focal, raster, resample, sample, scanline, warp
from fieldspark.operators.raster import layer
from workloads.inputs import PIXELS_SQL, SHIFTED_SQL, grids, pixels, shifted_grids, table, two_bands, with_sql
from workloads.tables_q import _round


def _out(df, digits=6):
    return df.select("row", "col", F.round("value", digits).alias("value"))


def _sql(body, *extra):
    return with_sql([PIXELS_SQL, *extra], body)


_AB = """ab AS (SELECT row, col, max(CASE WHEN raster_id=1 THEN value END) AS a, max(CASE WHEN raster_id=2 THEN value END) AS b,
 max(CASE WHEN raster_id=3 THEN value END) AS c, max(CASE WHEN raster_id=4 THEN value END) AS d
 FROM pixels GROUP BY row, col)"""


def ndvi(spark, sf):
    px = two_bands(pixels(spark, sf))
    return _out(raster.ndvi(px, layer(1), layer(4), grids=shifted_grids(spark, sf), to=1))


# What a raster has at the centres of raster 1's cells: the nearest pixel, and a bilinear mean of the pixels there are.
_AT_1 = """cells AS (SELECT r.i AS row, c.i AS col FROM range(64) r(i), range(64) c(i)),
near AS (SELECT cells.row, cells.col, p.raster_id, p.value FROM cells, g AS s, g AS t, pixels p
 WHERE t.raster_id = 1 AND p.raster_id = s.raster_id AND p.col = floor((cells.col + 0.5 - (s.x0 - t.x0)) / s.d)
 AND p.row = floor((cells.row + 0.5 - (t.y0 - s.y0)) / s.d) AND p.value <> -9999),
uv AS (SELECT cells.row, cells.col, s.raster_id, (cells.col + 0.5 - (s.x0 - t.x0)) / s.d - 0.5 AS u,
 (cells.row + 0.5 - (t.y0 - s.y0)) / s.d - 0.5 AS v FROM cells, g AS s, g AS t WHERE t.raster_id = 1),
smooth AS (SELECT uv.row, uv.col, uv.raster_id, sum((1 - abs(u - p.col)) * (1 - abs(v - p.row)) * value) / sum((1 - abs(u - p.col)) * (1 - abs(v - p.row))) AS value
 FROM uv JOIN pixels p ON p.raster_id = uv.raster_id AND p.col BETWEEN floor(u) AND floor(u) + 1 AND p.row BETWEEN floor(v) AND floor(v) + 1
 WHERE abs(u - p.col) < 1 AND abs(v - p.row) < 1 AND u BETWEEN -0.5 AND 63.5 AND v BETWEEN -0.5 AND 63.5 AND value <> -9999 GROUP BY ALL)"""


def ndre(spark, sf):
    return _out(raster.ndre(pixels(spark, sf), layer(1), layer(3)))


def gli(spark, sf):
    return _out(raster.gli(pixels(spark, sf), layer(1), layer(2), layer(3)))


def gli_alpha(spark, sf):
    px = pixels(spark, sf).withColumn(
        "value", F.when((F.col("raster_id") == 4) & (F.col("value") > 25), 255.0).otherwise(F.col("value"))
    )
    return _out(raster.gli(px, layer(1), layer(2), layer(3), layer(4)))


def canopy_height(spark, sf):
    px = pixels(spark, sf).withColumn(
        "value", F.when((F.col("row") + F.col("col")) % 9 == 0, -9999.0).otherwise(F.col("value"))
    )
    return _out(raster.canopy_height(px, layer(1), layer(4), grids=shifted_grids(spark, sf), to=1))


CHM_SQL = with_sql(
    [
        PIXELS_SQL.replace("pixels AS", "measured AS"),
        "pixels AS (SELECT raster_id, band, row, col, CASE WHEN (row + col) % 9 = 0 THEN -9999 ELSE value END AS value FROM measured)",
        SHIFTED_SQL,
        _AT_1,
    ],
    """SELECT row, col, round(CASE WHEN a.value IS NULL OR b.value IS NULL THEN -9999 ELSE greatest(a.value - b.value, 0) END, 6) AS value
FROM (SELECT * FROM near WHERE raster_id = 1) a FULL JOIN (SELECT * FROM smooth WHERE raster_id = 4) b USING (row, col)""",
)


def raster_differences(spark, sf):
    d = raster.raster_differences(two_bands(pixels(spark, sf)), shifted_grids(spark, sf))
    return _round(d)


DIFFERENCES_SQL = _sql(
    """SELECT p.raster_id AS raster_a, q.raster_id AS raster_b, count(*) AS count, round(min(p.value-q.value),6) AS min,
 round(max(p.value-q.value),6) AS max, round(max(p.value-q.value)-min(p.value-q.value),6) AS interval,
 round(avg(p.value-q.value),6) AS mean, round(stddev_samp(p.value-q.value),6) AS std_dev
FROM pixels p JOIN g t ON t.raster_id = p.raster_id JOIN g s ON s.raster_id > t.raster_id
JOIN pixels q ON q.raster_id = s.raster_id AND q.col = floor(((p.col + 0.5) * t.d - (s.x0 - t.x0)) / s.d)
 AND q.row = floor(((p.row + 0.5) * t.d - (t.y0 - s.y0)) / s.d)
GROUP BY 1, 2""",
    SHIFTED_SQL,
)


def weighted_average(spark, sf):
    px = two_bands(pixels(spark, sf))
    return _out(raster.weighted_average(px, {1: 2.0, 2: 1.0, 4: 0.5}, grids=shifted_grids(spark, sf)))


def adjust_mean(spark, sf):
    d = raster.adjust_mean(pixels(spark, sf), 100.0)
    return d.select("raster_id", "row", "col", F.round("value", 5).alias("value"))


def to_reflectance(spark, sf):
    d = raster.to_reflectance(pixels(spark, sf).withColumn("value", F.round("value")), nodata=25.0)
    return d.select("raster_id", "row", "col", "value")


def bands(spark, sf):
    """Stack three rasters to bands, take one back out."""
    px = pixels(spark, sf)
    stacked = raster.stack_bands([px.filter(layer(i)) for i in (1, 2, 3)])
    return _out(raster.extract_band(stacked, 2))


def alpha_mask(spark, sf):
    d = raster.alpha_mask(pixels(spark, sf), 25.0)
    return d.groupBy("raster_id", "value").agg(F.count(F.lit(1)).alias("n"))


def stretch_limits(spark, sf):
    return _round(raster.stretch_limits(pixels(spark, sf)))


STRETCH_SQL = _sql(
    """SELECT band, round(min(lo),6) AS low, round(max(hi),6) AS high FROM (SELECT raster_id, band,
 quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels GROUP BY 1, 2) GROUP BY band"""
)


def overviews(spark, sf):
    d = raster.overviews(pixels(spark, sf), (2, 4, 8))
    return d.select("level", "raster_id", "row", "col", F.round("value", 6).alias("value"))


OVERVIEW_SQL = _sql(
    "\nUNION ALL\n".join(
        f"SELECT {k} AS level, raster_id, row//{k} AS row, col//{k} AS col, round(avg(value),6) AS value FROM pixels GROUP BY ALL"
        for k in (2, 4, 8)
    )
)


def overviews_mode(spark, sf):
    px = pixels(spark, sf).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return raster.overviews(px, (4,), "mode").select("raster_id", "row", "col", "value")


OVERVIEW_MODE_SQL = _sql(
    """SELECT raster_id, row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY raster_id, row, col ORDER BY n DESC, value) AS rn
 FROM (SELECT raster_id, row//4 AS row, col//4 AS col, floor(value/10) AS value, count(*) AS n FROM pixels GROUP BY ALL)) WHERE rn = 1"""
)


def raster_summary(spark, sf):
    return _round(raster.summary(pixels(spark, sf)).drop("band"))


SUMMARY_SQL = _sql(
    """SELECT raster_id, count(*) AS count, 0.0 AS nodata_pct, round(min(value),6) AS min, round(max(value),6) AS max, round(avg(value),6) AS mean,
 round(stddev_pop(value),6) AS std, round(var_pop(value),6) AS variance, round(quantile_cont(value,0.5),6) AS median FROM pixels GROUP BY raster_id"""
)


def raster_histogram(spark, sf):
    return raster.histogram(pixels(spark, sf), 0.0, 50.0, 10).drop("band")


HISTOGRAM_SQL = _sql(
    """SELECT raster_id, CAST(least(floor(value/5), 9) AS INTEGER) AS bin, count(*) AS count, least(floor(value/5), 9)*5 AS "from"
FROM pixels WHERE value BETWEEN 0 AND 50 GROUP BY ALL"""
)


def class_areas(spark, sf):
    px = pixels(spark, sf).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return _round(raster.class_areas(px, 2.5).drop("band"))


AREAS_SQL = _sql(
    """SELECT raster_id, floor(value/10) AS value, count(*) AS count, round(count(*)*100.0/sum(count(*)) OVER (PARTITION BY raster_id),6) AS pct,
 count(*)*2.5 AS area FROM pixels GROUP BY raster_id, floor(value/10)"""
)


def correlation(spark, sf):
    return _round(raster.correlation(pixels(spark, sf), layer(1), layer(2)))


def reclassify(spark, sf):
    d = raster.reclassify(pixels(spark, sf), [(0, 20, 1), (20, 30, 2), (30, 99, 3)], default=0)
    d = raster.threshold(d, 2.0)
    return d.groupBy("raster_id", "value").agg(F.count(F.lit(1)).alias("n"))


def normalise_invert(spark, sf):
    d = raster.invert(raster.normalise(pixels(spark, sf)))
    return d.select("raster_id", "row", "col", F.round("value", 6).alias("value"))


NORMALISE_SQL = _sql(
    """SELECT raster_id, row, col, round(1 - (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value
FROM pixels WINDOW w AS (PARTITION BY raster_id)"""
)


def tile_index(spark, sf):
    tiles = raster.to_tiles(pixels(spark, sf).filter(layer(1) | layer(2)), 16)
    return _out(raster.from_tiles(raster.tile_index(tiles, layer(1), layer(2)), 16))


def resample_nearest(spark, sf):
    g = resample.Grid(0.0, 64.0, 2.0, 2.0, 32, 32)
    d = resample.resample(pixels(spark, sf), grids(spark, sf), g, "nearest")
    return d.select("raster_id", "row", "col", F.round("value", 6).alias("value"))


def resample_average(spark, sf):
    g = resample.Grid(0.0, 64.0, 4.0, 4.0, 16, 16)
    d = resample.resample(pixels(spark, sf), grids(spark, sf), g, "average")
    return d.select("raster_id", "row", "col", F.round("value", 6).alias("value"))


def resample_median(spark, sf):
    g = resample.Grid(0.0, 64.0, 8.0, 8.0, 8, 8)
    d = resample.resample(pixels(spark, sf), grids(spark, sf), g, "median")
    return d.select("raster_id", "row", "col", F.round("value", 6).alias("value"))


def resample_bilinear(spark, sf):
    g = resample.Grid(0.0, 64.0, 0.5, 0.5, 128, 128)
    d = resample.resample(pixels(spark, sf), grids(spark, sf), g, "bilinear")
    return d.select("raster_id", "row", "col", F.round("value", 6).alias("value"))


BILINEAR_SQL = _sql(
    """SELECT raster_id, tr AS row, tc AS col, round(sum(w*value)/sum(w),6) AS value FROM (
 SELECT p.raster_id, tr, tc, value, greatest(1-abs((tr+0.5)*0.5-0.5-p.row),0)*greatest(1-abs((tc+0.5)*0.5-0.5-p.col),0) AS w
 FROM pixels p, (SELECT unnest(range(-1,3)) AS a) ta, (SELECT unnest(range(-1,3)) AS b) tb,
 LATERAL (SELECT CAST(p.row*2+a AS INTEGER) AS tr, CAST(p.col*2+b AS INTEGER) AS tc)
 WHERE tr BETWEEN 0 AND 127 AND tc BETWEEN 0 AND 127) WHERE w > 0 GROUP BY 1, 2, 3"""
)


def _sample_points(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("fid"),
        (F.col("c_custkey") % 80 - 7.5).alias("x"),
        (F.col("c_custkey") % 77 - 5.5).alias("y"),
    )


SAMPLE_POINTS_SQL = "pts AS (SELECT c_custkey AS fid, c_custkey%80-7.5 AS x, c_custkey%77-5.5 AS y FROM customer)"


def sample_rasters(spark, sf):
    d = sample.sample_rasters(
        _sample_points(spark, sf), pixels(spark, sf), grids(spark, sf), raster_ids=[1, 2, 3], prefix="r_"
    )
    return _round(d.drop("x", "y"))


SAMPLE_SQL = _sql(
    "SELECT fid, "
    + ", ".join(f"round(max(CASE WHEN raster_id={i} THEN value END),6) AS r_{i}" for i in (1, 2, 3))
    + " FROM pts LEFT JOIN pixels ON row = CAST(floor(64 - y) AS INTEGER) AND col = CAST(floor(x) AS INTEGER) GROUP BY fid",
    SAMPLE_POINTS_SQL,
)


def altimetry(spark, sf):
    d = sample.altimetry(_sample_points(spark, sf), pixels(spark, sf).filter(layer(1)), grids(spark, sf).filter(layer(1, None)))
    return _round(d.drop("x", "y"))


ALTIMETRY_SQL = _sql(
    """SELECT fid, round(max(value),6) AS elevation FROM pts LEFT JOIN pixels ON raster_id = 1 AND row = CAST(floor(64-y) AS INTEGER)
 AND col = CAST(floor(x) AS INTEGER) GROUP BY fid""",
    SAMPLE_POINTS_SQL,
)


def _masks(spark, sf):
    """A box per nation and its lower-left triangle half."""
    n = table(spark, sf, "nation")
    x, y = (F.col("n_nationkey") * 2 + 0.25), (F.col("n_nationkey") * 3 % 50 + 0.25)
    return n.select(
        F.col("n_nationkey").alias("fid"),
        F.array(
            F.array(geo.point(x, y), geo.point(x + 10, y), geo.point(x, y + 6))
        ).alias("rings"),
    )


_MASK_SQL = """m AS (SELECT n_nationkey AS fid, n_nationkey*2+0.25 AS x, n_nationkey*3%50+0.25 AS y FROM nation),
c AS (SELECT *, col+0.5 AS px, 64-row-0.5 AS py FROM pixels)"""
_IN = "px > x AND py > y AND (px - x) / 10 + (py - y) / 6 < 1"


def clip_per_feature(spark, sf):
    d = sample.clip_raster(pixels(spark, sf), grids(spark, sf), _masks(spark, sf), per_feature=True)
    return d.select("feature", "raster_id", "row", "col")


def clip_all(spark, sf):
    d = sample.clip_raster(pixels(spark, sf), grids(spark, sf), _masks(spark, sf))
    return d.select("raster_id", "row", "col")


def zonal_statistics(spark, sf):
    return _round(sample.zonal_statistics(pixels(spark, sf), grids(spark, sf), _masks(spark, sf)).drop("band"))


def clip_buffer(spark, sf):
    d = sample.clip_raster(pixels(spark, sf), grids(spark, sf), _masks(spark, sf), per_feature=True, buffer_pixels=1.5)
    return d.select("feature", "raster_id", "row", "col")


def rasterize_polygons(spark, sf):
    masks = _masks(spark, sf).withColumn("value", F.col("fid") * 1.5)
    return scanline.rasterize_polygons(masks, grids(spark, sf)).select("raster_id", "row", "col", "value")


def gli_resampled(spark, sf):
    return _out(raster.gli(pixels(spark, sf), layer(1), layer(2), layer(3), grids=grids(spark, sf), to=1, resolution=2.0))


def stack_mixed(spark, sf):
    """Bands of 1 m and 2 m cells with corners of their own."""
    px, g = pixels(spark, sf), shifted_grids(spark, sf).filter(F.col("raster_id").isin(1, 4))
    d = raster.stack_bands([px.filter(layer(1)), px.filter(layer(4))], grids=g)
    return d.select("band", "row", "col", F.round("value", 6).alias("value"))


def focal_mean(spark, sf):
    d = focal.focal(pixels(spark, sf), 5, "mean", tile=16)
    return _round(d.drop("band"))


def focal_gaps(spark, sf):
    """Weighted means, also where a pixel is nodata."""
    px = pixels(spark, sf).withColumn("value", F.when((F.col("row") + F.col("col")) % 3 == 0, -9999.0).otherwise(F.col("value")))
    d = focal.focal(px, 3, nodata=-9999.0, weights=[[1, 2, 1], [2, 4, 2], [1, 2, 1]], gaps=True, tile=16)
    return _round(d.drop("band"))


def fill_nodata(spark, sf):
    px = pixels(spark, sf).filter((F.col("row") * 7 + F.col("col") * 3) % 11 < 2)
    d = focal.fill_nodata(px, grids(spark, sf), 6.0)
    return _round(d.drop("band"))


_WARP_GRID = resample.Grid(-52.9505, -22.5905, 0.0004, 0.0003, 60, 70)


def _utm_grids(spark, sf):
    """The rasters at 30 m, each some cells away from the others."""
    k = F.col("raster_id")
    size = {"dx": F.lit(30.0), "dy": F.lit(30.0)}
    return grids(spark, sf).withColumns({"x0": 300000.0 + 60 * k, "y0": 7500000.0 - 30 * k, **size})


def reproject_nearest(spark, sf):
    d = warp.reproject_raster(pixels(spark, sf), _utm_grids(spark, sf), _WARP_GRID, 4326, "nearest", 1e-5)
    return _round(d.drop("band"))


def reproject_bilinear(spark, sf):
    d = warp.reproject_raster(pixels(spark, sf), _utm_grids(spark, sf), _WARP_GRID, 4326, "bilinear", 0.0)
    return d.select("raster_id", "row", "col", F.round("value", 4).alias("value"))


def reproject_average(spark, sf):
    """Geographic cells averaged over UTM cells of 90 m."""
    g = _utm_grids(spark, sf).withColumns(
        {"x0": F.lit(-52.9505), "y0": F.lit(-22.5905), "dx": F.lit(0.0004), "dy": F.lit(0.0003), "srid": F.lit(4326)}
    )
    target = resample.Grid(299500.0, 7500700.0, 90.0, 90.0, 30, 30)
    return _round(warp.reproject_raster(pixels(spark, sf), g, target, 32722, "average").drop("band"))


def _utm_sql(lon: str, lat: str) -> str:
    """Columns x and y of UTM zone 22 south as a chain of subqueries over a relation `spots`."""
    n = "(1/298.257223563/(2-1/298.257223563))"
    e = "sqrt(1/298.257223563*(2-1/298.257223563))"
    radius = f"(0.9996*6378137/(1+{n})*(1+{n}**2/4+{n}**4/64))"
    alpha = (
        f"({n}/2-2*{n}**2/3+5*{n}**3/16+41*{n}**4/180)", f"(13*{n}**2/48-3*{n}**3/5+557*{n}**4/1440)",
        f"(61*{n}**3/240-103*{n}**4/140)", f"(49561*{n}**4/161280)",
    )
    north = " + ".join(f"{a}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    east = " + ".join(f"{a}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    return f"""SELECT *, 500000 + {radius}*(eta + {east}) AS x, 10000000 + {radius}*(xi + {north}) AS y FROM (
 SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM (
 SELECT *, sinh(atanh(s) - {e}*atanh({e}*s)) AS t FROM (SELECT *, sin(radians({lat})) AS s, radians({lon} + 51) AS dl FROM spots)))"""


_WARP_SQL = f"""spots AS (SELECT r AS row, c AS col, -52.9505 + (c+0.5)*0.0004 AS lon, -22.5905 - (r+0.5)*0.0003 AS lat
 FROM (SELECT unnest(range(70))::INT AS r), (SELECT unnest(range(60))::INT AS c)),
utm AS MATERIALIZED ({_utm_sql("lon", "lat")}),
src AS MATERIALIZED (SELECT k AS raster_id, row, col, (x-300000-60*k)/30 AS u, (7500000-30*k-y)/30 AS v FROM utm, (SELECT DISTINCT l_linenumber AS k FROM lineitem)
 WHERE u >= 0 AND v >= 0 AND u < 64 AND v < 64)"""


def clip_extent(spark, sf):
    g = grids(spark, sf).withColumn("srid", F.lit(4326))
    d = sample.clip_extent(pixels(spark, sf), g, (10.2, 5.3, 30.7, 40.1))
    return d.select("raster_id", "row", "col")


_IN_ALL = f"SELECT DISTINCT raster_id, row, col FROM c JOIN m ON {_IN}"
REGISTRY = {
    "ndvi": (
        ndvi,
        _sql(
            """SELECT row, col, round((a.value - b.value) / (abs(a.value + b.value) + 1e-10), 6) AS value
FROM near a JOIN near b USING (row, col) WHERE a.raster_id = 1 AND b.raster_id = 4""",
            SHIFTED_SQL, _AT_1,
        ),
    ),
    "ndre": (ndre, _sql("SELECT row, col, round((a-c)/(abs(a+c)+1e-10),6) AS value FROM ab WHERE a IS NOT NULL AND c IS NOT NULL", _AB)),
    "gli": (gli, _sql("SELECT row, col, round((2*b-a-c)/(2*b+a+c+1e-10),6) AS value FROM ab WHERE a+b+c IS NOT NULL", _AB)),
    "gli_alpha": (
        gli_alpha,
        _sql(
            "SELECT row, col, round(CASE WHEN d > 25 THEN (2*b-a-c)/(2*b+a+c+1e-10) ELSE -9999 END,6) AS value FROM ab WHERE a+b+c IS NOT NULL",
            _AB,
        ),
    ),
    "canopy_height": (canopy_height, CHM_SQL),
    "raster_differences": (raster_differences, DIFFERENCES_SQL),
    "weighted_average": (
        weighted_average,
        _sql(
            """SELECT row, col, round((2 * a.value + b.value + 0.5 * c.value) / 3.5, 6) AS value
FROM near a JOIN near b USING (row, col) JOIN near c USING (row, col) WHERE a.raster_id = 1 AND b.raster_id = 2 AND c.raster_id = 4""",
            SHIFTED_SQL, _AT_1,
        ),
    ),
    "adjust_mean": (
        adjust_mean,
        _sql("SELECT raster_id, row, col, round(value*100/avg(value) OVER (PARTITION BY raster_id),5) AS value FROM pixels"),
    ),
    "to_reflectance": (
        to_reflectance,
        _sql("SELECT raster_id, row, col, CASE WHEN round(value)=25 THEN 25 ELSE round(value)/10000 END AS value FROM pixels"),
    ),
    "bands": (bands, _sql("SELECT row, col, round(value,6) AS value FROM pixels WHERE raster_id = 2")),
    "alpha_mask": (
        alpha_mask,
        _sql("SELECT raster_id, CASE WHEN abs(value-25) <= 1e-6 THEN 0.0 ELSE 255.0 END AS value, count(*) AS n FROM pixels GROUP BY ALL"),
    ),
    "stretch_limits": (stretch_limits, STRETCH_SQL),
    "overviews": (overviews, OVERVIEW_SQL),
    "overviews_mode": (overviews_mode, OVERVIEW_MODE_SQL),
    "raster_summary": (raster_summary, SUMMARY_SQL),
    "raster_histogram": (raster_histogram, HISTOGRAM_SQL),
    "class_areas": (class_areas, AREAS_SQL),
    "raster_correlation": (
        correlation,
        _sql("SELECT count(*) AS count, round(corr(a,b),6) AS correlation FROM ab WHERE a+b IS NOT NULL", _AB),
    ),
    "reclassify": (
        reclassify,
        _sql("SELECT raster_id, CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END AS value, count(*) AS n FROM pixels GROUP BY ALL"),
    ),
    "normalise_invert": (normalise_invert, NORMALISE_SQL),
    "tile_index": (
        tile_index,
        _sql("SELECT row, col, round((a-b)/(abs(a+b)+1e-10),6) AS value FROM ab WHERE a IS NOT NULL AND b IS NOT NULL", _AB),
    ),
    "resample_nearest": (
        resample_nearest,
        _sql("SELECT raster_id, row//2 AS row, col//2 AS col, round(value,6) AS value FROM pixels WHERE row%2=1 AND col%2=1"),
    ),
    "resample_average": (
        resample_average,
        _sql("SELECT raster_id, row//4 AS row, col//4 AS col, round(avg(value),6) AS value FROM pixels GROUP BY 1,2,3"),
    ),
    "resample_median": (
        resample_median,
        _sql("SELECT raster_id, row//8 AS row, col//8 AS col, round(quantile_cont(value,0.5),6) AS value FROM pixels GROUP BY 1,2,3"),
    ),
    "resample_bilinear": (resample_bilinear, BILINEAR_SQL),
    "sample_rasters": (sample_rasters, SAMPLE_SQL),
    "altimetry": (altimetry, ALTIMETRY_SQL),
    "clip_per_feature": (
        clip_per_feature,
        _sql(f"SELECT fid AS feature, raster_id, row, col FROM c JOIN m ON {_IN}", _MASK_SQL),
    ),
    "clip_raster": (clip_all, _sql(_IN_ALL, _MASK_SQL)),
    "zonal_statistics": (
        zonal_statistics,
        _sql(
            f"""SELECT fid AS feature, raster_id, count(*) AS count, round(sum(value),6) AS sum, round(avg(value),6) AS mean,
 round(min(value),6) AS min, round(max(value),6) AS max, round(stddev_pop(value),6) AS std FROM c JOIN m ON {_IN} GROUP BY 1, 2""",
            _MASK_SQL,
        ),
    ),
    "clip_buffer": (
        clip_buffer,
        _sql(
            f"""SELECT feature, raster_id, row, col FROM (SELECT fid AS feature, raster_id, row, col, px - x AS u, py - y AS v, ({_IN}) AS inside
 FROM c CROSS JOIN m) WHERE inside OR least(
 sqrt((u - greatest(0, least(10, u))) ** 2 + v ** 2), sqrt(u ** 2 + (v - greatest(0, least(6, v))) ** 2),
 sqrt((u - 10 + 10 * greatest(0, least(1, (-10 * (u - 10) + 6 * v) / 136))) ** 2 + (v - 6 * greatest(0, least(1, (-10 * (u - 10) + 6 * v) / 136))) ** 2)) <= 1.5""",
            _MASK_SQL,
        ),
    ),
    "rasterize_polygons": (
        rasterize_polygons,
        """WITH m AS (SELECT n_nationkey AS fid, n_nationkey*2+0.25 AS x, n_nationkey*3%50+0.25 AS y FROM nation),
c AS (SELECT DISTINCT l_linenumber AS raster_id, r AS row, k AS col, k+0.5 AS px, 64-r-0.5 AS py
 FROM lineitem, (SELECT unnest(range(64))::INT AS r), (SELECT unnest(range(64))::INT AS k))
SELECT raster_id, row, col, max(fid) * 1.5 AS value FROM c JOIN m ON px > x AND py > y AND (px - x) / 10 + (py - y) / 6 < 1 GROUP BY ALL""",
    ),
    "gli_resampled": (
        gli_resampled,
        _sql("SELECT row//2 AS row, col//2 AS col, round((2*b-a-c)/(2*b+a+c+1e-10),6) AS value FROM ab WHERE a+b+c IS NOT NULL AND row%2=1 AND col%2=1", _AB),
    ),
    "stack_mixed": (
        stack_mixed,
        _sql(
            """SELECT 1 AS band, row+1 AS row, col, round(value,6) AS value FROM pixels WHERE raster_id = 1 UNION ALL
 SELECT 2, 2*row+i, 2*col+j, round(value,6) FROM pixels, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j) WHERE raster_id = 4"""
        ),
    ),
    "focal_mean": (
        focal_mean,
        _sql(
            """SELECT p.raster_id, p.row, p.col, round(avg(q.value),6) AS value FROM pixels p, (SELECT unnest(range(-2,3)) AS i), (SELECT unnest(range(-2,3)) AS j)
 JOIN pixels q ON q.raster_id = p.raster_id AND q.row = p.row + i AND q.col = p.col + j GROUP BY 1, 2, 3"""
        ),
    ),
    "focal_gaps": (
        focal_gaps,
        _sql(
            """SELECT p.raster_id, p.row, p.col, round(sum((2-abs(i))*(2-abs(j))*q.value)/sum((2-abs(i))*(2-abs(j))),6) AS value
 FROM pixels p, (SELECT unnest(range(-1,2)) AS i), (SELECT unnest(range(-1,2)) AS j)
 JOIN pixels q ON q.raster_id = p.raster_id AND q.row = p.row + i AND q.col = p.col + j AND (q.row + q.col) % 3 <> 0 GROUP BY 1, 2, 3"""
        ),
    ),
    "fill_nodata": (
        fill_nodata,
        _sql(
            """SELECT raster_id, row, col, round(arg_min(value, rank),6) AS value FROM (
 SELECT q.raster_id, q.row + i AS row, q.col + j AS col, q.value, (i*i+j*j) * 10000 + q.row * 100 + q.col AS rank
 FROM pixels q, (SELECT unnest(range(-6,7))::INT AS i), (SELECT unnest(range(-6,7))::INT AS j) WHERE (q.row*7+q.col*3) % 11 < 2 AND i*i+j*j <= 36)
 WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY 1, 2, 3"""
        ),
    ),
    "reproject_nearest": (
        reproject_nearest,
        _sql(
            """SELECT s.raster_id, s.row, s.col, round(value,6) AS value FROM src s
 JOIN pixels p ON p.raster_id = s.raster_id AND p.row = floor(v)::INT AND p.col = floor(u)::INT""",
            _WARP_SQL,
        ),
    ),
    "reproject_bilinear": (
        reproject_bilinear,
        _sql(
            """SELECT raster_id, row, col, round(sum(w*value)/sum(w),4) AS value FROM (
 SELECT s.raster_id, s.row, s.col, value, (1-abs(v-0.5-p.row))*(1-abs(u-0.5-p.col)) AS w FROM src s, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), pixels p
 WHERE p.raster_id = s.raster_id AND p.row = floor(v-0.5)::INT + i AND p.col = floor(u-0.5)::INT + j) WHERE w > 0 GROUP BY ALL""",
            _WARP_SQL,
        ),
    ),
    "reproject_average": (
        reproject_average,
        _sql(
            f"""SELECT raster_id, floor((7500700-y)/90)::INT AS row, floor((x-299500)/90)::INT AS col, round(avg(value),6) AS value
 FROM ({_utm_sql("lon", "lat")}) WHERE x >= 299500 AND y <= 7500700 AND x < 302200 AND y > 7498000 GROUP BY 1, 2, 3""",
            "spots AS (SELECT raster_id, value, -52.9505 + (col+0.5)*0.0004 AS lon, -22.5905 - (row+0.5)*0.0003 AS lat FROM pixels)",
        ),
    ),
    "clip_extent": (
        clip_extent,
        _sql("SELECT raster_id, row, col FROM pixels WHERE col+0.5 BETWEEN 10.2 AND 30.7 AND 63.5-row BETWEEN 5.3 AND 40.1"),
    ),
}
