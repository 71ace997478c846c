"""Best-fit packing of token pieces into sequences by large-item matching.

Pieces above a third of the capacity go at most two to a sequence: the longest takes the longest partner that still
fits.  Shorter pieces, longest first, fill the tightest gap that takes them.  Only the histogram of piece lengths, at
most `capacity` rows whatever the input, reaches the driver; it is packed in runs of equal sequences, and the plan's
rows say which ranks of a length go to which run.  Pieces are ranked within their length in salted groups.

Edge cases: null and empty texts are one piece with the end id alone; ties and repeated rows are separate pieces in an
order that their columns fix; an empty table packs to no rows; extra columns are ignored by `pieces`.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import written
from fieldspark.llm.tokens import Encoder

CAPACITY = 2048
#: Rows of one length are ranked in groups of about so many, in SALTS groups at most.
GROUP_ROWS, SALTS = 256, 4096


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", ids: bool = False
) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch["doc_id"].tolist(), encoder.encode_all(batch["t"]), strict=True):
                data = own + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own if ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield out if ids else out.drop(columns="ids")

    # Ids travel as text: pandas would turn long numbers beside nulls into floats.
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    rows = docs.select(F.col("doc_id").cast("string"), F.col(text).alias("t")).mapInPandas(cut, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """How the pieces of each length are dealt out, as rows (length, first, count, copies, base, offset).

    Ranks first .. first + count - 1 of a length go to sequences base, base + 1, ..., `copies` to each, from offset on."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a piece must have 1 to `capacity` tokens")
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    n_sequences = 0

    def give(length, count, copies, base, offset):
        rows.append((length, used[length], count, copies, base, offset))
        used[length] += count
        left[length] -= count

    def spare(gap, base, m):
        if gap and m:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((base, m))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            m = left[a]
            give(a, m, 1, n_sequences, 0)
            spare(capacity - a, n_sequences, m)
        else:
            b = large[at]
            m = left[a] // 2 if a == b else min(left[a], left[b])
            if m == 0:  # the last one of its length: its partner is the next shorter
                at -= 1
                while at >= 0 and not left[large[at]]:
                    large.pop(at)
                    at -= 1
                m = 1
                give(a, 1, 1, n_sequences, 0)
                if at >= 0:
                    b = large[at]
                    give(b, 1, 1, n_sequences, a)
                    spare(capacity - a - b, n_sequences, 1)
                else:
                    spare(capacity - a, n_sequences, 1)
            else:
                give(a, m, 1, n_sequences, 0)
                give(b, m, 1, n_sequences, a)
                spare(capacity - a - b, n_sequences, m)
        n_sequences += m

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                # No gap takes it: a run of new sequences as long as the rest fills them.
                m = -(-left[n] // (capacity // n))
                spare(capacity, n_sequences, m)
                n_sequences += m
                continue
            gap = sizes[at]
            base, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            copies = min(gap // n, left[n])
            full = min(m, left[n] // copies)
            give(n, full * copies, copies, base, capacity - gap)
            spare(gap - copies * n, base, full)
            spare(gap, base + full, m - full)
    return pd.DataFrame(rows, columns=["length", "first", "count", "copies", "base", "offset"])


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """rows with __rank, 0 to n - 1 within their length, and the histogram of lengths.

    A common length is split by a hash into groups that are ranked apart; a small table of group sizes shifts them."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    if not counts:
        return rows.withColumn("__rank", F.lit(0).cast("long")), counts
    spark = rows.sparkSession
    salts = spark.createDataFrame(
        [(n, min(SALTS, -(-c // GROUP_ROWS))) for n, c in counts.items()], "length long, __salts long"
    )
    salted = rows.join(F.broadcast(salts), "length").withColumn("__salt", F.expr(f"pmod(xxhash64({', '.join(order)}), __salts)"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = Window.partitionBy("length", "__salt").orderBy(*order)
    return (
        salted.withColumn("__own", F.row_number().over(own) - 1)
        .join(shift, ["length", "__salt"])
        .withColumn("__rank", F.col("__shift") + F.col("__own"))
        .drop("__salts", "__salt", "__own", "__shift")
    ), counts


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """rows (with a column length) with sequence_id and offset.  `order` names columns that tell rows apart.

    The rows are read several times: pass a written table."""
    numbered, counts = ranked(rows, order)
    layout = plan(counts, capacity).sort_values(["length", "first"])
    shipped = rows.sparkSession.sparkContext.broadcast({k: layout[k].to_numpy(np.int64) for k in layout})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shipped.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(rank):
            return pd.DataFrame({"sequence_id": rank, "offset": rank})
        at = np.searchsorted((p["length"] << 48) + p["first"], (length << 48) + rank, side="right") - 1
        k, copies = rank - p["first"][at], p["copies"][at]
        return pd.DataFrame({"sequence_id": p["base"][at] + k // copies, "offset": p["offset"][at] + k % copies * length})

    placed = numbered.select(*rows.columns, place(F.col("length").cast("long"), "__rank").alias("__at"))
    return placed.select(*rows.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents with their place in a sequence."""
    cut = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"], capacity)
