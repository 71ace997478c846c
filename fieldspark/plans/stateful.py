"""Sequential scans with a small carried state, spread over many tasks.

Small groups are scanned many at a time, so that what a kernel works out for all
rows costs one array operation for thousands of groups.  A large group is cut into pieces that are
scanned at the same time: every piece guesses the state it starts with by
scanning some rows before it, and afterwards the guess is compared with the
state the piece before really ended in.  Pieces with a wrong guess are scanned
again from the right state until all agree, so the result is that of one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import HALO, PIECE, Sequence
from fieldspark.plans.sizing import cut_lineage

# kernel(rows, starts) looks at the rows of several groups, which begin at ``starts``, and gives a scan of one of them:
# scan(first, last, begin, end, state) -> (results of begin..end as tuples that begin with the row's place, end state).
# The group's rows are first..last; those before ``begin`` and after ``end`` are context, state None starts a group.
Scan = Callable[[int, int, int, int, "str | None"], "tuple[list[tuple], str]"]
Kernel = Callable[[pd.DataFrame, np.ndarray], Scan]
# Rows that are scanned together at least, if a task has so many.
_TOGETHER = 50_000
_IN, _OUT, _AT = "_state_in", "_state_out", "_at"


def scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    kernel: Kernel,
    result: str,
    reach: int,
    warmup: int = 256,
    cut: bool | None = None,
) -> DataFrame:
    """Run ``kernel`` over every group; ``result`` is the DDL of its columns.

    The result also has the group columns and ``_piece``.  A kernel may return
    rows for context before its piece; the caller keeps the row with the highest
    piece number.
    """
    seq = Sequence(df, group, order, cut=cut)
    fields = [f for f in df.schema.fields if f.name in group]
    schema = T.StructType(fields)
    schema = schema.add(PIECE, T.IntegerType())
    for f in T._parse_datatype_string(result).fields:
        schema = schema.add(f)
    names = [f.name for f in schema.fields]

    if not seq.cut:
        results = [f.name for f in T._parse_datatype_string(result).fields]
        arrow = to_arrow_schema(schema)

        def several(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            frame = rows.drop_columns([c for c in group if c not in order]).to_pandas(integer_object_nulls=True)
            one, found = kernel(frame, starts), []
            for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                found.extend(one(first, last, first, last, None)[0])
            columns = list(zip(*found, strict=True)) or [()] * (len(results) + 1)
            made = dict(zip(results, columns[1:], strict=True))
            keys = rows.select(group).take(pa.array(columns[0], pa.int64()))
            made |= {g: keys.column(g) for g in group} | {PIECE: np.zeros(len(columns[0]), np.int32)}
            arrays = [
                made[f.name].cast(f.type).combine_chunks() if f.name in group else pa.array(made[f.name], f.type, from_pandas=True)
                for f in arrow
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size < _TOGETHER:
                    continue
                rows = pa.Table.from_batches(held)
                starts = np.flatnonzero(rows[_AT].to_numpy() == 1)
                # The last group may go on in the next batch.
                ends = int(starts[-1])
                if ends:
                    yield several(rows.slice(0, ends), starts[:-1])
                    held, size = rows.slice(ends).to_batches(), rows.num_rows - ends
            if size:
                rows = pa.Table.from_batches(held)
                yield several(rows, np.flatnonzero(rows[_AT].to_numpy() == 1))

        in_group = Window.partitionBy(*(group or [F.lit(1)])).orderBy(*order)
        placed = seq.df.withColumn(_AT, F.row_number().over(in_group)).sortWithinPartitions(*group, *order)
        return placed.mapInArrow(whole, schema)

    def tagged(found: list[tuple], rows: pd.DataFrame, piece: int) -> pd.DataFrame:
        out = pd.DataFrame([f[1:] for f in found], columns=[n for n in names if n not in group and n != PIECE])
        for g in group:
            out[g] = rows[g].iloc[0]
        out[PIECE] = piece
        return out

    with_state = schema.add(_IN, T.StringType()).add(_OUT, T.StringType())
    span = reach + warmup
    body = cut_lineage(seq.df.withColumn(HALO, F.lit(False)).unionByName(seq._halo(span)))

    def piece_scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        core = (~rows[HALO]).to_numpy().nonzero()[0]
        begin, end, piece = int(core[0]), int(core[-1]) + 1, int(rows[PIECE].iloc[core[0]])
        known = rows["_given"].iloc[begin]
        one = kernel(rows, np.zeros(1, int))
        if isinstance(known, str):
            state = known
        elif begin == 0:
            state = None
        else:
            # Scan the rows before the piece to guess its state; with the whole
            # start of the group in sight the guess is exact.
            first, cold = (0, None) if begin < span else (reach, "")
            _, state = one(0, len(rows), first, begin, cold)
        found, after = one(0, len(rows), begin, end, state)
        out = tagged(found, rows, piece)
        mark = tagged([(0, *[None] * (len(names) - len(group) - 1))], rows, piece)
        mark[_IN], mark[_OUT] = state, after
        out[_IN], out[_OUT] = None, None
        return pd.concat([out, mark], ignore_index=True)[[f.name for f in with_state.fields]]

    keys = [*group, PIECE]
    given = body.withColumn("_given", F.lit(None).cast("string"))
    done = cut_lineage(given.groupBy(*keys).applyInPandas(piece_scan, with_state))
    by_group = Window.partitionBy(*group).orderBy(PIECE)
    while True:
        states = done.filter(F.col(_OUT).isNotNull()).select(*keys, _IN, _OUT)
        wrong = states.withColumn("_given", F.lag(_OUT).over(by_group)).filter(
            F.col("_given").isNotNull() & ~F.col("_given").eqNullSafe(F.col(_IN))
        )
        wrong = wrong.select(*keys, "_given")
        if not wrong.head(1):
            return done.filter(F.col(_OUT).isNull()).drop(_IN, _OUT)
        # At most one row per range partition.
        again = join_on(body, wrong, keys, small=True)
        fixed = again.groupBy(*keys).applyInPandas(piece_scan, with_state)
        kept = join_on(done, wrong.withColumnRenamed("_given", "_x"), keys, "left", small=True)
        kept = kept.filter(F.col("_x").isNull()).drop("_x")
        done = cut_lineage(kept.unionByName(fixed))
