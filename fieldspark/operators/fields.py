"""Field calculators and schema edits on feature tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.functions.crs import is_geographic
from fieldspark.functions.text import present
from fieldspark.operators.stats import numeric_columns
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence

# Attributes a KML import adds.
KML_FIELDS = (
    "descriptio",
    "timestamp",
    "begin",
    "end",
    "altitudeMo",
    "tessellate",
    "extrude",
    "visibility",
    "drawOrder",
    "icon",
)


def difference_fields(
    df: DataFrame, base: str, exclude: Iterable[str] = (), prefix: str = "diff_", precision: int = 2
) -> DataFrame:
    """``column - base`` for every other numeric column, null where either is null."""
    names = numeric_columns(df, [base, *exclude])
    b = F.col(base).cast("double")
    return df.select(
        "*", *[F.bround(F.col(n).cast("double") - b, precision).alias(f"{prefix}{n}") for n in names]
    )


def point_xy(df: DataFrame, geom: str = "geom", precision: int = 8) -> DataFrame:
    g = F.col(geom)
    return df.withColumns({"x": F.bround(g.x, precision), "y": F.bround(g.y, precision)})


def resolve_mode(mode: str, srid: int) -> str:
    """Cartesian on a geographic layer means both."""
    return "both" if mode == "cartesian" and is_geographic(srid) else mode


def _metric(df, name, mode, srid, precision, measure, suffixes, max_len):
    mode = resolve_mode(mode, srid)
    planar_suffix, ellipsoid_suffix = suffixes
    out = {}
    if mode in ("cartesian", "both"):
        out[(name + planar_suffix)[:max_len]] = F.bround(measure(False), precision)
    if mode in ("ellipsoidal", "both"):
        out[(name + ellipsoid_suffix)[:max_len]] = F.bround(measure(True), precision)
    return df.withColumns(out)


def line_length(
    df: DataFrame,
    geom: str = "geom",
    mode: str = "ellipsoidal",
    precision: int = 4,
    srid: int = 4326,
    multi: bool = False,
    suffixes: tuple[str, str] = ("", "_eli"),
    max_len: int = 10,
) -> DataFrame:
    """Length of lines (or multi-lines): planar, on the ellipsoid, or both."""
    f = geo.multiline_length if multi else geo.line_length
    return _metric(
        df, "length", mode, srid, precision, lambda e: f(F.col(geom), e), suffixes, max_len
    )


def polygon_area_ha(
    df: DataFrame,
    geom: str = "geom",
    mode: str = "ellipsoidal",
    precision: int = 4,
    srid: int = 4326,
    suffixes: tuple[str, str] = ("", "_eli"),
    max_len: int = 10,
) -> DataFrame:
    """Area of polygons (ring arrays) in hectares."""
    return _metric(
        df,
        "area",
        mode,
        srid,
        precision,
        lambda e: geo.polygon_area(F.col(geom), e) / 10000.0,
        suffixes,
        max_len,
    )


def drop_kml_fields(df: DataFrame, fields: Seq[str] = KML_FIELDS) -> DataFrame:
    return df.drop(*fields)


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns, key=str.lower))


def next_name(base: str, taken: Iterable[str]) -> str:
    """``base``, or ``base_1``, ``base_2`` ... when taken."""
    taken = set(taken)
    if base not in taken:
        return base
    i = 1
    while f"{base}_{i}" in taken:
        i += 1
    return f"{base}_{i}"


def short_names(names: Iterable[str], taken: Iterable[str] = (), max_len: int = 10) -> list[str]:
    """Valid field names of limited length, made unique with a number at the end."""
    used, out = list(taken), []
    for name in names:
        base = re.sub(r"[^0-9A-Za-z_]", "_", name)
        candidate, i = base[:max_len], 0
        while candidate in used:
            i += 1
            tail = f"_{i}"
            candidate = base[: max_len - len(tail)] + tail
        used.append(candidate)
        out.append(candidate)
    return out


def copy_attributes(
    target: DataFrame,
    source: DataFrame,
    fields: Seq[str] | None = None,
    on_conflict: str = "skip",
    key: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Add the source's fields to the target: empty, or filled by ``key``.

    Of several source rows of a key the last by ``order`` counts, ties by their values.  ``on_conflict`` is ``skip``, ``rename``, ``replace`` or ``error``.
    """
    wanted = [f for f in source.schema.fields if (fields is None or f.name in fields) and f.name != key]
    names: dict[str, str] = {}
    for f in wanted:
        if f.name not in target.columns:
            names[f.name] = f.name
        elif on_conflict == "error":
            raise ValueError(f"field {f.name} exists")
        elif on_conflict == "rename":
            names[f.name] = next_name(f.name, [*target.columns, *names.values()])
        elif on_conflict == "replace":
            names[f.name] = f.name
    replaced = [n for n in names.values() if n in target.columns]
    base = target.drop(*replaced)
    if key is None:
        types = {f.name: f.dataType for f in wanted}
        return base.withColumns({n: F.lit(None).cast(types[o]) for o, n in names.items()})
    given = list(names.values())
    rank = source[order] if order else F.lit(0)
    side = source.select(key, rank.alias("_rank"), *[F.col(o).alias(n) for o, n in names.items()])
    one = side.groupBy(key).agg(F.max_by(F.struct(*given), F.struct("_rank", *given)).alias("_one"))
    return join_on(base, one.select(key, "_one.*"), [key], "left")


def project_outputs(
    df: DataFrame, original: Seq[str], selected: Seq[str], required: str = "shot_id"
) -> DataFrame:
    """Original columns plus the chosen outputs; outputs win over equal names."""
    chosen = [required, *[s for s in selected if s != required]]
    kept = [c for c in original if c not in chosen]
    return df.select(*kept, *[c for c in chosen if c in df.columns])


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c.cast("string")) for c in cols])


def group_letter(index: Column) -> Column:
    """A..Z for 0..25, then A1..Z1, A2.. and so on."""
    letter = F.chr((F.lit(65) + index % 26).cast("bigint"))
    return F.when(index < 26, letter).otherwise(
        F.concat(letter, F.floor(index / 26).cast("bigint").cast("string"))
    )


def prefix_ids(
    df: DataFrame, group: str, order: str, ids: Seq[str] = ("shot_id", "old_shot_id")
) -> DataFrame:
    """Put the letter of the group, in order of first appearance, before non-zero ids."""
    seen = df.groupBy(group).agg(F.min(order).alias("_first"))
    # Groups are numbered as one ordered sequence, cut into pieces when there are many.
    letters = Sequence(seen, [], ["_first", group]).number("_rank").result()
    letters = letters.select(group, group_letter(F.col("_rank") - 1).alias("_letter"))
    out = join_on(df, letters, [group], "left")
    for name in ids:
        if name in out.columns:
            c = F.col(name).cast("string")
            out = out.withColumn(name, F.when(c == "0", c).otherwise(F.concat("_letter", c)))
    return out.drop("_letter")


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def update_by_map(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace values found in the mapping, keep the others."""
    if not mapping:
        return df
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))
