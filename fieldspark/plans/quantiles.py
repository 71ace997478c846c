"""Order statistics per group without holding a group in one task: exact ones, and sketches of a fixed size.

A sketch (KLL) is worked out while rows are read, is merged like any partial aggregate and never grows beyond its size
``k``; quantiles from it are values of the data whose ranks are off by at most `rank_error` of the rows, with a
probability of 99 %.  Saved sketches of parts (days, flights) merge into that of the whole without reading rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence
from fieldspark.plans.sizing import fits_one_task


def order_statistics(
    df: DataFrame,
    group: list[str],
    value: str,
    quantiles: dict[str, float],
    mode: str = "linear",
    decimals: int | None = None,
    cut: bool | None = None,
    times: str | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of the non-null values.

    ``linear`` interpolates between ranks, ``floor`` takes the value at rank
    ``int(q * (n - 1))``.  Equal values are counted first, so the ordered part
    works on distinct values.  ``times`` names a column that says how many rows
    a row stands for.
    """
    count = F.lit(1) if times is None else F.col(times)
    rows = df.select(*group, F.col(value).cast("double").alias("_q"), count.alias("_times")).filter(F.col("_q").isNotNull())
    if cut is None:
        cut = not fits_one_task(rows, group)
    if not cut and mode == "linear" and times is None:
        names = list(quantiles)
        agg = rows.groupBy(*group).agg(
            F.percentile("_q", F.array(*[F.lit(quantiles[n]) for n in names])).alias("_p")
        )
        return agg.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    counts = rows.groupBy(*group, "_q").agg(F.sum("_times").alias("_m"))
    ranked = Sequence(counts, group, ["_q"], cut=cut).running(_upto=F.col("_m")).result()
    totals = rows.groupBy(*group).agg(F.sum("_times").alias("_total"))
    ranked = join_on(ranked, totals, group)

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(inside, F.col("_q")))

    picks, out = [], []
    for i, (name, q) in enumerate(quantiles.items()):
        pos = F.lit(q) * (F.col("_total") - 1)
        low = F.floor(pos)
        picks.append(at(low).alias(f"_lo{i}"))
        if mode == "floor":
            out.append(F.col(f"_lo{i}").alias(name))
            continue
        picks.append(at(F.ceil(pos)).alias(f"_hi{i}"))
        picks.append(F.max(pos - low).alias(f"_w{i}"))
        lo, hi, w = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        out.append(F.when(w == 0, lo).otherwise(lo * (1 - w) + hi * w).alias(name))
    return ranked.groupBy(*group).agg(*picks).select(*group, *out)


def approx_quantiles(
    df: DataFrame, group: list[str], value: str, quantiles: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    names = list(quantiles)
    agg = df.groupBy(*group).agg(
        F.percentile_approx(value, [quantiles[n] for n in names], accuracy).alias("_p")
    )
    return agg.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])




#: Size of a sketch: about 40 kB, ranks within 0.13 % of the rows.
SKETCH_SIZE = 4096


def rank_error(k: int = SKETCH_SIZE) -> float:
    """Share of the rows by which the rank of a sketch's quantile may be off, with a probability of 99 %."""
    # The published fit of the error to the size.
    return 2.296 / k**0.9021


def sketches(df: DataFrame, group: list[str], value: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable sketch per group of the values that are numbers: binary column `sketch`."""
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_q")).filter(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*group).agg(F.kll_sketch_agg_double("_q", F.lit(k)).alias("sketch"))


def merge_sketches(parts: DataFrame, group: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of parts as one per (coarser) group."""
    return parts.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles_of(state: DataFrame, group: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Values counted and the named quantiles of every sketch; no quantiles where a sketch is empty."""
    n = F.kll_sketch_get_n_double("sketch")
    picks = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in quantiles.items()]
    # Without a group there is a sketch of nothing for no rows.
    return state.select(*group, n.alias("count"), *picks)
