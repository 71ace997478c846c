"""File inventory, delimited points, XMP blocks, text grids and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.text import plain_num
from fieldspark.operators.photos import canonicalize_map
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.sizing import broadcast_if_small
from fieldspark.sources.ranges import find_block, open_file, read_lines

# File extensions by kind.
RASTER = ("tif", "tiff", "ecw", "jp2", "img", "asc", "vrt")
VECTOR = ("shp", "gpkg", "geojson", "kml", "kmz", "gml", "csv")
#: Bytes of a text grid that its header is looked for in.
HEAD_BYTES = 1 << 16
FLIGHT_FOLDER = r"(?i)DJI_\d+_(\d+?)_([^_/]+)"


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Paths and sizes only; the content column is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "modificationTime")


def scan_folder(
    spark: SparkSession, path: str, exts: Iterable[str] | None = None, drop_last: bool = False
) -> DataFrame:
    """Files under a folder with extension, kind and the relative folder as group."""
    wanted = [e.lower().lstrip(".") for e in (exts or (*RASTER, *VECTOR))]
    d = _files(spark, path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    clean = F.regexp_replace("path", r"^file:/+", "/")
    root = path.rstrip("/").replace("file://", "")
    rel = F.regexp_replace(F.substring(clean, len(root) + 1, 1_000_000), r"^/+", "")
    folder = F.regexp_replace(rel, r"/?[^/]*$", "")
    group = F.regexp_replace(folder, r"/?[^/]*$", "") if drop_last else folder
    return d.select(
        clean.alias("path"),
        ext.alias("ext"),
        F.when(ext.isin(*RASTER), "raster").when(ext.isin(*VECTOR), "vector").otherwise("other").alias("kind"),
        group.alias("group"),
        "length",
        "modificationTime",
    ).filter(F.col("ext").isin(*wanted))


def read_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with a valid position get a point geometry; the others drop out."""
    px, py = plain_num(F.col(x)), plain_num(F.col(y))
    ok = px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)
    return df.filter(ok).withColumn("geom", geo.point(px, py))


def photo_skeleton(inventory: DataFrame, base: str) -> DataFrame:
    """Photo files of an inventory with folder levels (nearest first) and flight."""
    clean = F.regexp_replace("path", r"\\", "/")
    d = inventory.select(clean.alias("Path")).withColumn("File", F.regexp_extract("Path", r"([^/]+)$", 1))
    d = d.filter(F.col("File").rlike(r"(?i)_(\d{4})(?:_[A-Z])?\.JPG$"))
    root = base.rstrip("/")
    rel = F.substring("Path", len(root) + 2, 1_000_000)
    parts = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(root.rsplit("/", 1)[-1])))
    d = d.withColumn("_p", F.reverse(parts))
    levels = {f"FolderLevel{i}": F.coalesce(F.get("_p", F.lit(i - 1)), F.lit("")) for i in range(1, 6)}
    flight = F.get(F.filter("_p", lambda p: p.rlike(FLIGHT_FOLDER)), F.lit(0))
    return d.withColumns(
        {
            **levels,
            "FlightNumber": F.regexp_extract(flight, FLIGHT_FOLDER, 1).try_cast("int"),
            "FlightName": F.regexp_extract(flight, FLIGHT_FOLDER, 2),
        }
    ).drop("_p")


def read_mrk(spark: SparkSession, path: str, levels: int = 5) -> DataFrame:
    """Position logs: one row per line that has number, latitude, longitude and height.

    Folder levels count from the nearest folder outward; missing ones are null.
    """
    lines = spark.read.text(path, pathGlobFilter="*.[mM][rR][kK]", recursiveFileLookup=True)
    return parse_mrk(lines.select("value", F.col("_metadata.file_path").alias("mrk_path")), path, levels)


_MRK = r"(?i)(\d+).*?(-?\d+\.\d+),Lat.*?(-?\d+\.\d+),Lon.*?(-?\d+(?:\.\d+)?),Ellh"
_MRK_FILE = r"(?i)DJI_\d+_(\d+?)_([^_]+?)_Timestamp"


def parse_mrk(lines: DataFrame, base: str, levels: int = 5) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("mrk_path", r"^file:/+", "/"), "%20", " ")
    d = lines.filter(F.col("value").rlike(_MRK)).withColumn("mrk_path", path)
    d = d.withColumn("mrk_file", F.regexp_extract("mrk_path", r"([^/]+)$", 1))
    folder_path = F.regexp_replace("mrk_path", r"/[^/]+$", "")
    root = base.rstrip("/").replace("file://", "")
    names = F.split(F.substring(folder_path, len(root.rsplit("/", 1)[0]) + 2, 1_000_000), "/")

    def text(pattern: str, group: int) -> Column:
        t = F.regexp_extract("mrk_file", pattern, group)
        return F.when(t != "", t)

    def number(group: int) -> Column:
        return F.regexp_extract("value", _MRK, group).cast("double")

    return d.select(
        F.regexp_extract("value", _MRK, 1).cast("int").alias("foto"),
        number(2).alias("lat"),
        number(3).alias("lon"),
        number(4).alias("alt"),
        text(r"(?i)DJI_(\d{8})", 1).alias("date_name"),
        F.regexp_extract(folder_path, r"([^/]+)$", 1).alias("folder"),
        folder_path.alias("folder_path"),
        "mrk_file",
        "mrk_path",
        text(_MRK_FILE, 1).alias("flight_number"),
        text(_MRK_FILE, 2).alias("flight_name"),
        *[F.get(F.reverse(names), F.lit(i)).alias(f"folder_level{i + 1}") for i in range(levels)],
    )


DEWARP = ("FocalX", "FocalY", "Cx", "Cy", "K1", "K2", "K3", "P1", "P2")


def parse_dewarp(raw: Column) -> Column:
    """Date and up to nine coefficients of a lens correction text, null when malformed."""
    parts = F.split(raw, ";")
    values = F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda v: F.trim(v).try_cast("double"))
    whole = ~F.exists(values, lambda v: v.isNull())
    fields = [F.trim(F.get(parts, F.lit(0))).alias("DewarpDate")]
    fields += [F.when(whole, F.get(values, F.lit(i))).alias(f"Dewarp{n}") for i, n in enumerate(DEWARP)]
    return F.when(F.size(parts) >= 2, F.struct(*fields))


def parse_xmp(content: DataFrame, body: str = "content") -> DataFrame:
    """Attributes of the XMP block in image bytes as a canonical map."""
    text = F.decode(body, "ISO-8859-1")
    block = F.regexp_extract(text, r"(?s)<x:xmpmeta.*?</x:xmpmeta>", 0)
    head = F.regexp_extract(block, r"(?s)<rdf:Description\b(.*?)>", 1)
    names = F.regexp_extract_all(head, F.lit(r"""([\w-]+:[\w-]+)\s*=\s*"([^"]*)\""""), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"""([\w-]+:[\w-]+)\s*=\s*"([^"]*)\""""), F.lit(2))
    d = content.withColumn("_a", F.arrays_zip(names.alias("k"), values.alias("v")))
    seen = F.filter("_a", lambda e: ~e["k"].startswith("xmlns:"))
    keys = F.array_distinct(F.transform(seen, lambda e: e["k"]))
    attrs = F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(seen, lambda e: e["k"] == k), 1)["v"]))
    )
    d = d.withColumn("xmp", attrs)
    dewarp = F.coalesce(
        F.try_element_at("xmp", F.lit("drone-dji:DewarpData")), F.try_element_at("xmp", F.lit("DewarpData"))
    )
    return d.withColumns({"attributes": canonicalize_map(F.col("xmp")), "dewarp": parse_dewarp(dewarp)}).drop("_a")


def read_xmp(spark: SparkSession, path: str, pattern: str = "*.[jJ][pP][gG]", tail: int = 1 << 16) -> DataFrame:
    """XMP attributes of the images under a folder, with size in MB.

    Spark lists the images; tasks read the last `tail` bytes of each, and more only where the block is not there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = reader.option("pathGlobFilter", pattern).load(path).select("path", "length")

    def blocks(batches):
        for b in batches:
            found = []
            for uri, size in zip(b["path"], b["length"], strict=True):
                with open_file(uri) as f:
                    found.append(find_block(f, size, b"<x:xmpmeta", b"</x:xmpmeta>", tail))
            yield b.assign(content=found)

    d = listed.mapInPandas(blocks, "path string, length long, content binary").withColumns(
        {
            "Path": F.regexp_replace("path", r"^file:/+", "/"),
            "SizeMb": F.bround(F.col("length") / (1024.0 * 1024.0), 2),
            "content": F.coalesce("content", F.lit(b"")),
        }
    )
    out = parse_xmp(d.select("Path", "SizeMb", "content"))
    return out.withColumn("File", F.regexp_extract("Path", r"([^/]+)$", 1)).drop("content")


def read_ascii_grid(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, grids) of text grids: a header of up to seven lines, then one line per row.

    A large grid is read in byte ranges by many tasks: lines of values are counted for each range first, and a line's
    row is the count before its range and its place in it.  Files of one name are one raster, told apart by nothing."""
    named_raster = F.regexp_replace("file_name", r"\.[^.]+$", "").alias("raster_id")
    heads = read_lines(spark, path, most=HEAD_BYTES, head=HEAD_BYTES).filter("number < 7").select(
        named_raster, "file_path", "number", F.split(F.lower(F.trim("value")), r"\s+").alias("_p")
    )

    def head(name: str, default: float | None = None) -> Column:
        named = F.get("_p", F.lit(0)).startswith(name)
        v = F.min_by(F.when(named, F.get("_p", F.lit(1)).try_cast("double")), F.when(named, F.col("number")))
        return v if default is None else F.coalesce(v, F.lit(default))

    size = head("cellsize")
    left = F.coalesce(head("xllcorner"), head("xllcenter") - size / 2)
    bottom = F.coalesce(head("yllcorner"), head("yllcenter") - size / 2)
    grids = heads.groupBy("raster_id", "file_path").agg(
        left.alias("x0"),
        (bottom + head("nrows") * size).alias("y0"),
        size.alias("dx"),
        size.alias("dy"),
        head("ncols").cast("int").alias("ncols"),
        head("nrows").cast("int").alias("nrows"),
        F.lit(None).cast("int").alias("srid"),
        head("nodata_value", -9999.0).alias("nodata"),
    ).drop("file_path")
    body = read_lines(spark, path, most=range_bytes, match=r"^\s*[-+0-9.]").filter("matched is not null")
    # One row a range: how many lines of values the file has before it.
    counts = body.groupBy("file_path", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file_path", "start", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = join_on(body, broadcast_if_small(starts), ["file_path", "start"])
    pixels = placed.select(
        named_raster, F.lit(1).alias("band"), (F.col("_before") + F.col("matched")).cast("int").alias("row"),
        F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "_v"),
    ).select("raster_id", "band", "row", "col", F.col("_v").try_cast("double").alias("value"))
    return pixels, grids


def write_stats_csv(stats: DataFrame, path: str, precision: int = 2, comma_decimal: bool = False) -> None:
    """Statistics as delimited text; missing values are empty fields."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind not in ("double", "float"):
            return c.cast("string").alias(name)
        t = F.bround(c, precision).cast("string")
        t = F.when(c.isNull() | F.isnan(c), "").otherwise(t)
        return (F.replace(t, F.lit("."), F.lit(",")) if comma_decimal else t).alias(name)

    # One row per field, so one file.
    out = stats.select(*[shown(n, t) for n, t in stats.dtypes]).coalesce(1)
    out.write.mode("overwrite").option("header", True).option("sep", ";" if comma_decimal else ",").option(
        "emptyValue", ""
    ).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def geojson_lines(df: DataFrame, geom: str = "geom", kind: str = "point") -> DataFrame:
    """Features as one GeoJSON text per row."""

    def xy(p: Column) -> Column:
        return F.array(p.x, p.y)

    g = F.col(geom)
    coords, name = {
        "point": (xy(g), "Point"),
        "line": (F.transform(g, xy), "LineString"),
        "polygon": (
            F.transform(g, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), xy)),
            "Polygon",
        ),
    }[kind]
    props = F.struct(*[F.col(c) for c in df.columns if c != geom]) if len(df.columns) > 1 else F.struct(F.lit(None).alias("_"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(name).alias("type"), coords.alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    return df.select(F.to_json(feature).alias("value"))


def save_layer(df: DataFrame, path: str, mode: str = "rename", geom: str = "geom", kind: str = "point") -> str:
    """Write parquet, or GeoJSON lines for a .geojson path; returns the path used.

    ``rename`` adds a number to a taken name, ``overwrite`` replaces, ``error`` fails.
    """
    spark, target = df.sparkSession, path
    if mode == "rename":
        stem, dot, ext = path.rpartition(".")
        if not dot or "/" in ext:
            stem, dot, ext = path, "", ""
        i = 1
        while _exists(spark, target):
            target = f"{stem}_{i}{dot}{ext}"
            i += 1
    how = "overwrite" if mode == "overwrite" else "error"
    if target.endswith((".geojson", ".geojsonl")):
        geojson_lines(df, geom, kind).write.mode(how).text(target)
    else:
        df.write.mode(how).parquet(target)
    return target


def write_if_absent(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key is not in the product yet; returns how many were written.

    A failed or repeated run leaves the same product behind.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(key)
    if _exists(spark, path):
        have = spark.read.parquet(path).select(*key).distinct()
        new = join_on(new, have.withColumn("_have", F.lit(True)), key, "left")
        new = new.filter(F.col("_have").isNull()).drop("_have")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
