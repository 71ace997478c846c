"""Scene catalogue search and band plans."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.catalog import literal_map
from fieldspark.functions.text import safe_path

# Bands with name, resolution and asset aliases, and band compositions.
BANDS = {
    "B01": ("Coastal Aerosol", 60, ["coastal", "B01"]),
    "B02": ("Blue", 10, ["blue", "B02"]),
    "B03": ("Green", 10, ["green", "B03"]),
    "B04": ("Red", 10, ["red", "B04"]),
    "B05": ("Red Edge", 20, ["rededge1", "B05"]),
    "B06": ("Red Edge", 20, ["rededge2", "B06"]),
    "B07": ("Red Edge", 20, ["rededge3", "B07"]),
    "B08": ("Near Infrared", 10, ["nir", "B08"]),
    "B8A": ("Red Edge", 20, ["nir08", "B8A"]),
    "B09": ("Water Vapour", 60, ["nir09", "B09"]),
    "B11": ("SWIR 1", 20, ["swir16", "B11"]),
    "B12": ("SWIR 2", 20, ["swir22", "B12"]),
    "SCL": ("Scene Classification", 20, ["scl", "SCL"]),
}
COMPOSITIONS = {
    "RGB": ["B04", "B03", "B02"],
    "FALSA_COR": ["B08", "B04", "B03"],
    "SWIR": ["B12", "B8A", "B04"],
    "AGRICULTURA": ["B11", "B08", "B02"],
    "URBANO": ["B12", "B11", "B04"],
    "NDVI": ["B08", "B04"],
    "TODAS": None,
}


def search_scenes(
    catalog: DataFrame,
    bbox: tuple[float, float, float, float],
    date_from: str,
    date_to: str,
    max_cloud: float = 100.0,
    limit: int | None = 200,
    key: str = "id",
) -> DataFrame:
    """Scenes whose box meets ``bbox`` in a date range under a cloud limit, oldest first.

    A missing cloud share counts as 0; the end date includes the whole day.
    """
    xmin, ymin, xmax, ymax = (float(v) for v in bbox)
    b = F.col("bbox")
    d = catalog.filter(
        (b.xmin <= xmax) & (b.xmax >= xmin) & (b.ymin <= ymax) & (b.ymax >= ymin)
        & (F.col("datetime") >= F.lit(date_from).cast("timestamp"))
        & (F.col("datetime") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
        & (F.coalesce(F.col("clouds"), F.lit(0.0)) <= float(max_cloud))
    )
    d = d.orderBy("datetime", key)
    return d.limit(limit) if limit else d


def resolve_bands(chosen: Seq[str] | dict[str, bool]) -> list[str]:
    """Band names of bands and compositions, in order, without repeats."""
    named = isinstance(chosen, dict)
    out: list[str] = []
    for name in [k for k, on in chosen.items() if on] if named else chosen:
        if name in COMPOSITIONS:
            out.extend(COMPOSITIONS[name] or BANDS)
        elif not named or name in BANDS:
            out.append(name)
    return list(dict.fromkeys(out))


def asset_key(assets: Column, band: Column) -> Column:
    """Key a scene stores a band under: its own name, an alias, else the name."""
    aliases = literal_map({b: ",".join(v[2]) for b, v in BANDS.items()}, "string", "string")
    names = F.split(F.coalesce(F.try_element_at(aliases, band), band), ",")
    found = F.filter(names, lambda n: F.array_contains(F.map_keys(assets), n))
    return F.when(F.array_contains(F.map_keys(assets), band), band).otherwise(
        F.coalesce(F.try_element_at(found, F.lit(1)), band)
    )


def plan_scene_products(
    scenes: DataFrame,
    chosen: Seq[str] | dict[str, bool],
    done: DataFrame | None = None,
    reflectance: bool = True,
    epsg: int | None = None,
    clip: bool = False,
) -> DataFrame:
    """Products to make for each scene and band: asset, target path and steps.

    Products listed in ``done`` (by path) are left out.
    """
    bands = resolve_bands(chosen)
    prefix = safe_path(F.concat_ws("_", "date", "tile", "platform"))
    prefix = F.when(F.regexp_replace(prefix, "_", "") == "", F.col("id")).otherwise(prefix)
    d = scenes.withColumns({"prefix": prefix, "band": F.explode(F.array(*[F.lit(b) for b in bands]))})
    scaled = F.lit(reflectance) & (F.upper("band") != "SCL")
    tail = F.when(scaled, "_refl.tif").otherwise(".tif")
    d = d.select(
        "id",
        "band",
        "prefix",
        asset_key(F.col("assets"), F.col("band")).alias("asset"),
        F.concat("prefix", F.lit("/"), "prefix", F.lit("_"), "band", tail).alias("path"),
        scaled.alias("to_reflectance"),
        F.lit(clip).alias("clip"),
        (F.lit(epsg).cast("int").isNotNull() & (F.col("epsg") != F.lit(epsg).cast("int"))).alias("reproject"),
    )
    hrefs = scenes.select(F.col("id"), F.explode("assets").alias("asset", "_href"))
    d = d.join(hrefs, ["id", "asset"], "left").withColumnRenamed("_href", "href")
    return d if done is None else d.join(done.select("path").distinct(), "path", "left_anti")


def compositions_for(bands: Seq[str]) -> list[str]:
    """Compositions of at least three bands that the given bands allow."""
    have = set(bands)
    return [n for n, b in COMPOSITIONS.items() if b and len(b) >= 3 and have.issuperset(b)]
