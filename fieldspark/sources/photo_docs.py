"""Photo metadata documents (schema version 2.0): folder groups of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.catalog import FIELDS
from fieldspark.operators.photos import raw
from fieldspark.operators.report import doc_quality
from fieldspark.plans.keyjoin import join_on

VERSION = "2.0"
_ROOT = (
    "schema_version string, source string, tool_key string, base_folder string, generated_at string, "
    "timestamps map<string,string>, groups map<string,struct<MrkFile:string,FlightName:string,"
    "FlightNumber:string,records:map<string,map<string,string>>>>"
)


def read_photo_docs(
    spark: SparkSession, path: str, fields: tuple[str, ...] | None = None, lines: bool = False
) -> DataFrame:
    """Records of all documents under a path, one row each.

    Catalogue fields become columns, everything else stays in ``extras``.  A
    document of another version raises an error.  ``lines`` reads one document
    per line, the form ``write_photo_docs`` writes.
    """
    docs = spark.read.schema(_ROOT).json(path, multiLine=not lines)
    ok = F.col("schema_version") == VERSION
    message = F.concat(F.lit("schema_version "), F.coalesce("schema_version", F.lit("missing")), F.lit(" is not supported"))
    docs = docs.filter(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))
    groups = docs.select("timestamps", F.explode("groups").alias("folder", "_g"))
    rows = groups.select("folder", "timestamps", F.explode("_g.records").alias("file", "_r"))
    names = list(fields or FIELDS)
    known = F.array(*[F.lit(n) for n in names])
    return rows.select(
        "folder",
        "file",
        *[F.try_element_at("_r", F.lit(n)).alias(n) for n in names],
        F.map_filter("_r", lambda k, _: ~F.array_contains(known, k)).alias("extras"),
        "timestamps",
    )


def document_groups(df: DataFrame) -> DataFrame:
    """Records by folder with flight fields and counts; the records stay separate rows."""
    path_folder = F.regexp_replace(raw(df, "Path"), r"[/\\][^/\\]*$", "")
    folder = F.coalesce(raw(df, "MrkFolder"), path_folder, F.lit(""))
    d = df.withColumn("_folder", folder)
    return d.groupBy(F.col("_folder").alias("folder")).agg(
        F.min(raw(df, "MrkFile")).alias("MrkFile"),
        F.min(raw(df, "FlightName")).alias("FlightName"),
        F.min(raw(df, "FlightNumber")).alias("FlightNumber"),
        F.count(F.lit(1)).alias("points_count"),
        F.count(F.lit(1)).alias("indexed_count"),
    )


def _file_key(df: DataFrame) -> Column:
    foto = F.concat(F.lit("foto_"), raw(df, "Foto"))
    # A name of the record's own values, the same in every run.
    number = F.concat(F.lit("record_"), F.hex(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])))
    return F.coalesce(raw(df, "File"), foto, number)


def write_photo_docs(
    df: DataFrame,
    path: str,
    source: str = "",
    tool_key: str = "",
    base_folder: str = "",
    generated_at: str = "",
) -> None:
    """Write documents that ``read_photo_docs`` reads back, one per record and line.

    No task holds a folder, whatever its size.  Each document carries its folder's counts and the quality
    counters of the whole set.
    """
    path_folder = F.regexp_replace(raw(df, "Path"), r"[/\\][^/\\]*$", "")
    folder = F.coalesce(raw(df, "MrkFolder"), path_folder, F.lit(""))
    fields = F.map_filter(
        F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]),
        lambda _, v: v.isNotNull(),
    )
    rows = df.select(folder.alias("folder"), _file_key(df).alias("file"), fields.alias("record"))
    groups = document_groups(df)
    docs = join_on(rows, groups, ["folder"]).withColumn("records", F.create_map("file", "record"))
    group = F.struct("MrkFile", "FlightName", "FlightNumber", "points_count", "indexed_count", "records")
    quality = doc_quality(df)
    out = docs.crossJoin(F.broadcast(quality.select(F.struct("*").alias("quality"))))  # one row
    body = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.lit(source).alias("source"),
        F.lit(tool_key).alias("tool_key"),
        F.lit(base_folder).alias("base_folder"),
        F.lit(generated_at).alias("generated_at"),
        "quality",
        F.create_map(F.col("folder"), group).alias("groups"),
    )
    # One document per line, so large sets stay splittable.
    out.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)
