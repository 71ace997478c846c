"""Ordered windows that stay bounded when one group holds most of the rows.

A window partitioned by the group puts a whole group into one task.  When the
largest group is small that is the best plan.  When it is not, the rows are range
partitioned by (group, order), so a large group spans many pieces.  Every piece
gets the few neighbour rows a bounded frame can reach, and unbounded running
values are the local value plus an offset from a table with one row per piece.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.sizing import cut_lineage, fits_one_task, group_limit

PIECE, HALO, POS = "_piece", "_halo", "_pos"
Bounded = Callable[[DataFrame, WindowSpec], DataFrame]


class Sequence:
    """Rows of ``df`` as one ordered sequence per group.

    ``order`` names columns that together are unique inside a group.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str], cut: bool | None = None):
        self.group, self.order = list(group), list(order)
        self.cut = (not fits_one_task(df, self.group)) if cut is None else cut
        self.df = df
        self.pieces: DataFrame | None = None
        if self.cut:
            self._cut(df)

    def _cut(self, df: DataFrame) -> None:
        rows = df.count()
        n = max(2, -(-rows // max(1, group_limit(df.sparkSession) // 2)))
        ranged = df.repartitionByRange(n, *self.group, *self.order)
        # The piece number must not change between uses, so it is written down once.
        self.df = cut_lineage(ranged.withColumn(PIECE, F.spark_partition_id()))
        sizes = self.df.groupBy(*self.group, PIECE).agg(F.count(F.lit(1)).alias("_n"))
        whole = Window.partitionBy(*self.group)
        seq = whole.orderBy(PIECE)
        before = seq.rowsBetween(Window.unboundedPreceding, -1)
        # At most two rows per range partition: only groups that span pieces stay.
        self.pieces = (
            sizes.withColumn("_parts", F.count(F.lit(1)).over(whole))
            .filter(F.col("_parts") > 1)
            .withColumn("_idx", F.row_number().over(seq))
            .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_parts")
        )

    @property
    def window(self) -> WindowSpec:
        keys = [*self.group, PIECE] if self.cut else (self.group or [F.lit(1)])
        return Window.partitionBy(*keys).orderBy(*self.order)

    def bounded(self, reach: int, body: Bounded) -> Sequence:
        """Run ``body(df, window)``, whose frames together reach at most ``reach`` rows."""
        if not self.cut:
            self.df = body(self.df, self.window)
            return self
        rows = self.df.withColumn(HALO, F.lit(False)).unionByName(self._halo(reach))
        self.df = body(rows, self.window).filter(~F.col(HALO)).drop(HALO)
        return self

    def _halo(self, reach: int) -> DataFrame:
        """Copies of the rows within ``reach`` of a piece, tagged with that piece."""
        names = self.df.columns
        keys = [*self.group, PIECE]
        edge = join_on(self.df, self.pieces, keys, small=True)
        rank = F.row_number().over(self.window)
        edge = (
            edge.withColumn(POS, rank)
            .filter((F.col(POS) <= reach) | (F.col(POS) > F.col("_n") - reach))
            .withColumn(POS, F.col(POS) + F.col("_start"))
            .drop("_n", "_start", PIECE)
            .withColumn(
                "_to",
                F.explode(
                    F.filter(
                        F.sequence(F.col("_idx") - reach, F.col("_idx") + reach),
                        lambda k: (k != F.col("_idx")) & (k >= 1),
                    )
                ),
            )
        )
        first, last = F.col("_start"), F.col("_start") + F.col("_n")
        near = F.col(POS).between(first - reach + 1, first) | F.col(POS).between(last + 1, last + reach)
        target = self.pieces.withColumnRenamed("_idx", "_to")
        hit = join_on(edge.drop("_idx"), target, [*self.group, "_to"], small=True)
        return hit.filter(near).select(*names, F.lit(True).alias(HALO))

    def running(self, **sums: Column) -> Sequence:
        """Inclusive running sums over the whole group."""
        w = self.window.rowsBetween(Window.unboundedPreceding, 0)
        tmp = {f"_v_{k}": c for k, c in sums.items()}
        df = self.df.withColumns(tmp) if tmp else self.df
        local = df.withColumns({k: F.sum(f"_v_{k}").over(w) for k in sums})
        if not self.cut:
            self.df = local.drop(*tmp)
            return self
        totals = df.groupBy(*self.group, PIECE).agg(*[F.sum(t).alias(t) for t in tmp])
        before = self._pieces_before()
        offsets = self._split_only(totals).select(
            *self.group, PIECE, *[F.sum(t).over(before).alias(f"_o{t}") for t in tmp]
        )
        joined = join_on(local, offsets, [*self.group, PIECE], "left", small=True)
        self.df = joined.withColumns(
            {k: F.col(k) + F.coalesce(F.col(f"_o_v_{k}"), F.lit(0)) for k in sums}
        ).drop(*tmp, *[f"_o{t}" for t in tmp])
        return self

    def _pieces_before(self) -> WindowSpec:
        w = Window.partitionBy(*self.group).orderBy(PIECE)
        return w.rowsBetween(Window.unboundedPreceding, -1)

    def _split_only(self, per_piece: DataFrame) -> DataFrame:
        """Piece rows of groups that span pieces, at most two per range partition."""
        return join_on(per_piece, self.pieces.select(*self.group, PIECE), [*self.group, PIECE], small=True)

    def number(self, name: str) -> Sequence:
        """1-based row number inside the group."""
        return self.running(**{name: F.lit(1)})

    def last_before(self, name: str, value: Column) -> Sequence:
        """Last non-null ``value`` strictly before the row, in the whole group."""
        w = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.df = self.df.withColumn("_lv", value)
        local = self.df.withColumn(name, F.last("_lv", ignorenulls=True).over(w))
        if not self.cut:
            self.df = local.drop("_lv")
            return self
        # The piece's own last value, carried over later pieces of the group.
        at = F.when(F.col("_lv").isNotNull(), F.struct(*self.order))
        lasts = self.df.groupBy(*self.group, PIECE).agg(F.max_by("_lv", at).alias("_last"))
        carried = self._split_only(lasts).select(
            *self.group, PIECE, F.last("_last", True).over(self._pieces_before()).alias("_carried")
        )
        self.df = (
            join_on(local, carried, [*self.group, PIECE], "left", small=True)
            .withColumn(name, F.coalesce(name, "_carried"))
            .drop("_carried", "_lv")
        )
        return self

    def total(self, name: str, key: list[str] | None = None) -> Sequence:
        """Row count per ``key`` (the group by default), added to every row."""
        keys = self.group if key is None else key
        if not self.cut:
            self.df = self.df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
            return self
        counts = self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        self.df = join_on(self.df, counts, keys, "left")
        return self

    def result(self) -> DataFrame:
        return self.df.drop(PIECE) if self.cut else self.df
