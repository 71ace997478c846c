"""Attribute statistics and small aggregates over tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.text import finite
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.quantiles import approx_quantiles, order_statistics
from fieldspark.plans.sizing import fits_one_task

STATISTICS = (
    "mean_abs",
    "mean",
    "std_pop",
    "std_samp",
    "min",
    "max",
    "range",
    "median",
    "p5",
    "p95",
    "mode",
    "variance",
    "sum",
    "cv",
    "skew",
    "kurt",
)
_QUANTILES = {"median": 0.5, "p5": 0.05, "p95": 0.95}


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def _moments(v: Column) -> list[Column]:
    sd, mean = F.stddev_pop(v), F.avg(v)
    return [
        F.count(v).alias("count"),
        F.avg(F.abs(v)).alias("mean_abs"),
        mean.alias("mean"),
        sd.alias("std_pop"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std_samp"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"),
        F.var_pop(v).alias("variance"),
        F.sum(v).alias("sum"),
        F.when(mean != 0, sd / mean).alias("cv"),
        F.when(sd > 0, F.skewness(v)).alias("skew"),
        F.when(sd > 0, F.kurtosis(v)).alias("kurt"),
    ]


def attribute_statistics(
    df: DataFrame,
    exclude: Iterable[str] = (),
    stats: Seq[str] = STATISTICS,
    precision: int | None = None,
    group_by: Seq[str] = (),
    approx: bool = False,
    cut: bool | None = None,
) -> DataFrame:
    """One row per numeric field (and group): count and the chosen statistics.

    Non-finite values are skipped.  Up to the group limit one aggregate does it
    all; above it percentiles and mode come from distributed value counts, so no
    task holds the values of a whole field.  ``approx`` uses sketch percentiles.
    """
    group = list(group_by)
    fields = numeric_columns(df, [*exclude, *group])
    if not fields:
        raise ValueError("no numeric field")
    if cut is None:
        cut = not fits_one_task(df, group)
    d = df.select(
        *group, *[F.when(finite(F.col(f)), F.col(f).cast("double")).alias(f) for f in fields]
    )
    long = d.unpivot(group, fields, "field", "value")
    keys = [*group, "field"]
    v = F.col("value")
    if not cut:
        # Percentiles and mode work on counted values, which are far fewer than rows.
        values = long.filter(v.isNotNull())
        counts = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
        if approx:
            pct = F.percentile_approx(v, list(_QUANTILES.values()), 10000)
        else:
            pct = F.percentile(v, F.array(*[F.lit(q) for q in _QUANTILES.values()]), F.col("m"))
        most = F.max_by("value", F.struct(F.col("m"), -v)).alias("mode")
        source = values.withColumn("m", F.lit(1)) if approx else counts
        spots = source.groupBy(*keys).agg(pct.alias("_p"), *([] if approx else [most]))
        if approx:
            spots = join_on(spots, counts.groupBy(*keys).agg(most), keys)
        spots = spots.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(_QUANTILES)], "mode")
        out = join_on(long.groupBy(*keys).agg(*_moments(v)), spots, keys, "left")
    else:
        values = long.filter(v.isNotNull())
        counts = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
        mode = counts.groupBy(*keys).agg(F.max_by("value", F.struct(F.col("m"), -v)).alias("mode"))
        if approx:
            pct = approx_quantiles(values, keys, "value", _QUANTILES)
        else:
            pct = order_statistics(values, keys, "value", _QUANTILES, cut=True)
        out = long.groupBy(*keys).agg(*_moments(v))
        out = join_on(join_on(out, pct, keys, "left"), mode, keys, "left")
    chosen = [F.col(s) if precision is None else F.bround(s, precision).alias(s) for s in stats]
    return out.select(*keys, "count", *chosen)


def percentile_stats(
    df: DataFrame, value: str, group_by: Seq[str] = (), decimals: int = 2, cut: bool | None = None, sketch: int | None = None
) -> DataFrame:
    """Mean, p5, p95 and their range with floor-index percentiles.

    ``sketch`` is the size of a sketch to take the percentiles from: one pass over the rows in bounded memory, ranks
    within `plans.quantiles.rank_error` of that size."""
    group = list(group_by)
    rows = df.select(*group, F.col(value).cast("double").alias("_x")).filter(finite(F.col("_x")))
    wanted = {"_p5": 0.05, "_p95": 0.95}
    mean = [F.count(F.lit(1)).alias("count"), F.avg("_x").alias("_mean")]
    if sketch:
        state = rows.groupBy(*group).agg(*mean, F.kll_sketch_agg_double("_x", F.lit(sketch)).alias("sketch"))
        pick = lambda q: F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
        both = state.select(*group, "count", "_mean", *[pick(q).alias(n) for n, q in wanted.items()])
    else:
        both = join_on(rows.groupBy(*group).agg(*mean), order_statistics(rows, group, "_x", wanted, "floor", cut=cut), group)
    return both.select(
        *group,
        "count",
        F.bround("_mean", decimals).alias("mean"),
        F.bround("_p5", decimals).alias("p5"),
        F.bround("_p95", decimals).alias("p95"),
        F.bround(F.col("_p95") - F.col("_p5"), decimals).alias("range"),
    )


def profile_types(df: DataFrame, columns: Seq[str] | None = None) -> DataFrame:
    """Narrowest of int, double, bool, string for every text column, in one pass.

    One number with a decimal point makes a column double even next to other
    text; a column of whole numbers must hold nothing else.
    """
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    long = df.select(*names).unpivot([], names, "field", "value")
    long = long.withColumn("raw", F.replace(F.trim("value"), F.lit("+"), F.lit("")))
    raw, low = F.col("raw"), F.lower("raw")
    filled = F.coalesce(F.trim("value") != "", F.lit(False))
    word = low.rlike("^(none|null|nan|inf|true|false)?$")
    whole = raw.rlike(r"^-?\d+$")
    flags = long.select(
        "field",
        filled.alias("filled"),
        (~word & whole & raw.try_cast("int").isNotNull()).alias("is_int"),
        (~word & ~whole & raw.try_cast("double").isNotNull()).alias("is_double"),
        low.rlike("^(true|false)$").alias("is_bool"),
    )
    f = F.col("filled")
    agg = flags.groupBy("field").agg(
        F.count_if(f & F.col("is_int")).alias("_i"),
        F.count_if(f & F.col("is_double")).alias("_d"),
        F.count_if(f & ~F.col("is_int") & ~F.col("is_double")).alias("_o"),
        F.count_if(f & F.col("is_bool")).alias("_b"),
        F.count_if(f).alias("_f"),
    )
    kind = (
        F.when(F.col("_d") > 0, "double")
        .when((F.col("_i") > 0) & (F.col("_o") == 0), "int")
        .when((F.col("_f") > 0) & (F.col("_b") == F.col("_f")), "bool")
        .otherwise("string")
    )
    return agg.select("field", kind.alias("type"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def duplicates(df: DataFrame, keys: Seq[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def distinct_ordered(df: DataFrame, keys: Seq[str], pos: str) -> DataFrame:
    """Distinct keys with the position of their first appearance."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def files_by_dir(df: DataFrame, path: str) -> DataFrame:
    """A row per file: its directory and its name.  No shuffle, whatever a directory holds."""
    return df.select(
        F.regexp_replace(F.col(path), r"/[^/]*$", "").alias("directory"),
        F.regexp_extract(path, r"([^/]*)$", 1).alias("file"),
    )


def group_by_dir(df: DataFrame, path: str) -> DataFrame:
    """A row per directory with its number of files; `files_by_dir` lists them."""
    return files_by_dir(df, path).groupBy("directory").agg(F.count(F.lit(1)).alias("file_count"))


def visible_columns(df: DataFrame, columns: Seq[str]) -> DataFrame:
    """Whether each metric column has any value that is neither null, "N/A" nor zero."""

    def shown(name: str) -> Column:
        c = F.col(name)
        text = F.trim(c.cast("string"))
        zero = F.coalesce(text.try_cast("double") == 0, F.lit(False)) if name not in strings else F.lit(False)
        return c.isNotNull() & ~text.isin("", "N/A") & ~zero

    strings = {n for n, t in df.dtypes if t == "string"}
    flags = [F.coalesce(F.max(shown(c)), F.lit(False)).alias(c) for c in columns]
    one = df.agg(*flags)
    return one.unpivot([], list(columns), "column", "visible")
