"""Hard negatives by angular triangle filtering.

Vectors are whole numbers, floor(256 * component); a score is their inner product.  Every vector keeps its norm and its
angles to a few reference directions.  For an anchor a and a row x the triangle inequality of angles gives

    max |angle(a, r) - angle(x, r)|  <=  angle(a, x)  <=  min (angle(a, r) + angle(x, r)),  and at most 2 pi less that sum,

over all references r.  The cosines of both ends, times both norms and rounded outwards, bound the score.  Rows lie in
blocks that are sorted by angle, with the same bounds for a whole block; integer products are worked out only where the
bounds meet a window of scores that is still open.

Two searches of the same kind follow one another: positives (all scores, same label, POSITIVES best) and, for each
positive, negatives (scores of its window, other label, NEGATIVES best).  Blocks of anchors meet blocks of rows as a grid
of cells (anchor group, row slab), each a bounded number of blocks of a bounded number of rows, so no task holds more
than a cell whatever the data; a cell returns its best rows only.  A first search over one slab in PROBE gives every
window a score that the last wanted row reaches, which closes the window from below before all slabs are searched.

The references are REFERENCES of SAMPLE rows (those with the smallest hashes of their ids), picked far apart: they only
decide how tight bounds are, results do not depend on them.

Results of edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; components
that one vector has and another lacks count as 0, so an empty vector scores 0 with all; a zero vector has angle pi / 2 to
everything; repeated rows each take part, and a row is no positive of an anchor with its id; an anchor without positives,
or a positive without rows in its window (negative positives have empty ones), gives no rows; an empty table gives none;
a vector whose norm reaches 2 ** 29 raises an error, as products could pass 64 bits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import written

POSITIVES, NEGATIVES = 5, 10
#: Reference directions, and rows they are picked from.
REFERENCES, SAMPLE = 8, 512
#: Rows of a block, anchors of a block, and blocks of a cell.
ROWS, ANCHORS, CELL_ROWS, CELL_ANCHORS = 2048, 256, 128, 512
#: Every how many slabs one is searched first.
PROBE = 8
#: Angles are stored in single precision; both ends of an interval move by this much.
SLACK = 2e-6
LARGEST_NORM = 2.0**29
#: No score is as large.
FAR = 1 << 60

BLOCK = (
    "block long, slab long, label long, n int, width int, wide boolean, ids binary, vectors binary, norms binary, angles binary, "
    "least_norm double, most_norm double, least_angles array<double>, most_angles array<double>"
)


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, embedding of rows that take part."""
    label = F.col("label") if label is None else label
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .filter(F.coalesce(fine, F.lit(False)))
    )


def whole(lists: pa.Array) -> np.ndarray:
    """A matrix of floor(256 * component) from lists of doubles; shorter ones are filled up with 0."""
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    values = np.floor(256.0 * np.asarray(lists.flatten(), dtype=np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def angles_to(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to unit vectors; pi / 2 for zero vectors."""
    norm = np.sqrt((x * x).sum(1))
    width = min(x.shape[1], references.shape[1])
    cosine = (x[:, :width] @ references[:, :width].T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def pick_references(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of rows far apart among a bounded sample."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = whole(pa.array([r.embedding for r in found], pa.list_(pa.float64())))
    # A reference beyond the numbers it may have points nowhere in particular; norms are checked on every row later.
    x /= np.maximum(np.abs(x).max(1, initial=0), 1)[:, None]
    norm = np.sqrt((x * x).sum(1))
    x = x[norm > 0] / norm[norm > 0][:, None]
    picked = [0] if len(x) else []
    while picked and len(picked) < min(references, len(x)):
        nearest = np.abs(x @ x[picked].T).max(1)
        far = int(nearest.argmin())
        if nearest[far] > 0.999:
            break
        picked.append(far)
    return x[picked] if picked else np.ones((1, 1))


def _measured(references: np.ndarray):
    """Rows with norm, angles, and the reference they are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("embedding"))
            norm, angle = angles_to(x, references)
            if norm.max(initial=0) >= LARGEST_NORM:
                raise ValueError(f"a vector's norm is {norm.max():.3g} times 1/256; it must be below {LARGEST_NORM:.3g}")
            near = angle.argmin(1)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "near": pa.array(near, pa.int32()),
                    "angle": pa.array(angle[np.arange(len(near)), near] if len(near) else np.zeros(0)),
                    "norm": pa.array(norm),
                    "angles": pa.array([a.tobytes() for a in angle.astype("<f4")], pa.binary()),
                    "vector": pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()),
                }
            )

    return run


def _packed(most: int, references: int, names: list[str]):
    """Sorted rows as blocks of one label and at most `most` rows."""

    def block(number: int, part: int, rows: list[pa.Table]) -> dict:
        t = pa.concat_tables(rows)
        ids = t["vec_id"].to_numpy()
        # By id, so that of equal scores the smaller id comes first.
        order = np.argsort(ids, kind="stable")
        bytes_of = t["vector"].to_pylist()
        width = max(map(len, bytes_of)) // 4
        x = np.zeros((len(ids), width), "<i4")
        for to, i in enumerate(order):
            own = np.frombuffer(bytes_of[i], "<i4")
            x[to, : len(own)] = own
        wide = bool(len(x) and x.size and np.abs(x).max() > 32767)
        norm = t["norm"].to_numpy()[order]
        angle = np.frombuffer(b"".join(t["angles"].to_pylist()), "<f4").reshape(len(ids), references)[order]
        return {
            "block": (part << 24) + number, "slab": part + number, "label": t["label"][0].as_py(), "n": len(ids), "width": width, "wide": wide,
            "ids": ids[order].astype("<i8").tobytes(), "vectors": x.astype("<i4" if wide else "<i2").tobytes(),
            "norms": norm.astype("<f8").tobytes(), "angles": angle.tobytes(), "least_norm": norm.min(), "most_norm": norm.max(),
            "least_angles": angle.min(0).astype(float).tolist(), "most_angles": angle.max(0).astype(float).tolist(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held, size, label = [], 0, None

        def made():
            values = block(number, part, held)
            return pa.RecordBatch.from_pylist([{k: values[k] for k in names}], schema=schema)

        schema = pa.schema(
            [("block", pa.int64()), ("slab", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("wide", pa.bool_())]
            + [(k, pa.binary()) for k in ("ids", "vectors", "norms", "angles")]
            + [(k, pa.float64()) for k in ("least_norm", "most_norm")]
            + [(k, pa.list_(pa.float64())) for k in ("least_angles", "most_angles")]
        )
        for batch in batches:
            t, at = pa.Table.from_batches([batch]), 0
            labels = t["label"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(labels)) + 1, len(labels))
            for end in ends:
                while at < end:
                    if held and (labels[at] != label or size == most):
                        yield made()
                        held, size, number = [], 0, number + 1
                    label, take = labels[at], min(int(end) - at, most - size)
                    held.append(t.slice(at, take))
                    size, at = size + take, at + take
        if held:
            yield made()

    return run


def pack(measured: DataFrame, parts: int, most: int, references: int, name: str) -> DataFrame:
    """Blocks of rows with like angles, written to the shared folder."""
    order = ["label", "near", "angle", "vec_id"]
    sorted_rows = measured.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return written(sorted_rows.mapInArrow(_packed(most, references, names), BLOCK), name)


class _Block:
    """A block as arrays."""

    def __init__(self, row):
        self.label, n = row.label, row.n
        self.ids = np.frombuffer(row.ids, "<i8")
        self.x = np.frombuffer(row.vectors, "<i4" if row.wide else "<i2").reshape(n, row.width)
        self.norm = np.frombuffer(row.norms, "<f8")
        self.angle = np.frombuffer(row.angles, "<f4").reshape(n, -1).astype(float)
        self.norms = (row.least_norm, row.most_norm)
        self.angles = (np.asarray(row.least_angles), np.asarray(row.most_angles))


def _ends(low: np.ndarray, high: np.ndarray, a: np.ndarray, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of angles and of norms, rounded outwards."""
    up, down = np.cos(np.clip(low - SLACK, 0, np.pi)), np.cos(np.clip(high + SLACK, 0, np.pi))
    up, down = a * np.maximum(up * least, up * most), a * np.minimum(down * least, down * most)
    room = 1 + 1e-9 * a * most
    return np.floor(down - room), np.ceil(up + room)


def block_bounds(a: _Block, x: _Block) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and the greatest score that a row of the block can have."""
    first, last = x.angles
    apart = np.maximum(np.maximum(a.angle - last, first - a.angle), 0).max(1)
    sums = np.minimum(a.angle + last, 2 * np.pi - (a.angle + first)).min(1)
    return _ends(apart, np.minimum(sums, np.pi), a.norm, *x.norms)


def row_bounds(a: _Block, use: np.ndarray, x: _Block) -> tuple[np.ndarray, np.ndarray]:
    """The same for each anchor in use and each row."""
    low, high = np.zeros((len(use), len(x.ids))), np.full((len(use), len(x.ids)), np.pi)
    for r in range(x.angle.shape[1]):
        t, own = a.angle[use, r][:, None], x.angle[:, r][None, :]
        np.maximum(low, np.abs(t - own), out=low)
        np.minimum(high, np.minimum(t + own, 2 * np.pi - (t + own)), out=high)
    return _ends(low, high, a.norm[use][:, None], x.norm[None, :], x.norm[None, :])


def products(a: _Block, x: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of anchors i with rows j, all against all."""
    width = min(a.x.shape[1], x.x.shape[1])
    kind = np.float64 if a.norm.max(initial=0) * x.norm.max(initial=0) < 2.0**53 else np.int64
    # Every partial sum of whole numbers is at most the product of the norms, so doubles are exact below 2 ** 53.
    return (a.x[i, :width].astype(kind) @ x.x[j, :width].astype(kind).T).astype(np.int64)


class _Best:
    """The k best rows of each window, by score and then by id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.score = np.full((*low.shape, k), -FAR)
        self.ids = np.full((*low.shape, k), FAR)

    def open(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether scores between least and most can be wanted, by window."""
        return (most >= self.low) & (least <= self.high) & (self.low <= self.high)

    def add(self, a: np.ndarray, w: int, score: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """score and wanted: a row for each anchor of a, a column for each id, ids ascending."""
        masked = np.where(wanted & (score >= self.low[a, w, None]) & (score <= self.high[a, w, None]), score, -FAR)
        if masked.shape[1] > self.k:
            least = np.partition(masked, -self.k, axis=1)[:, -self.k]
            masked[masked < least[:, None]] = -FAR
        i, j = np.nonzero(masked > -FAR)
        if not len(i):
            return
        own, new = np.unique(i), masked[i, j]
        rows = np.concatenate([i, np.repeat(own, self.k)])
        scores = np.concatenate([new, self.score[a[own], w].ravel()])
        names = np.concatenate([ids[j], self.ids[a[own], w].ravel()])
        order = np.lexsort((names, -scores, rows))
        rows, scores, names = rows[order], scores[order], names[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.score[a[rows[keep]], w, rank[keep]] = scores[keep]
        self.ids[a[rows[keep]], w, rank[keep]] = names[keep]
        # A later row must reach the last one kept; equal scores may still win by id.
        self.low[a[own], w] = np.maximum(self.low[a[own], w], self.score[a[own], w, -1])


def search_block(a: _Block, low: np.ndarray, high: np.ndarray, blocks: list[_Block], k: int, same_label: bool) -> tuple[_Best, int]:
    """The best rows of some blocks for each window (anchor, number) from low to high, and how many products it took."""
    best, scored = _Best(low, high, k), 0
    usable_blocks = [x for x in blocks if (x.label == a.label) == same_label]
    bounds = [block_bounds(a, x) for x in usable_blocks]
    # Blocks that can hold the highest scores come first: they close the windows for the others.
    for b in sorted(range(len(bounds)), key=lambda b: -bounds[b][1].max()):
        x, (least, most) = usable_blocks[b], bounds[b]
        use = np.flatnonzero(best.open(least[:, None], most[:, None]).any(1))
        if not len(use):
            continue
        under, over = row_bounds(a, use, x)
        meets = [
            (over >= best.low[use, w, None]) & (under <= best.high[use, w, None]) & (best.low[use, w] <= best.high[use, w])[:, None]
            for w in range(low.shape[1])
        ]
        wanted = np.logical_or.reduce(meets)
        if same_label:
            wanted &= a.ids[use][:, None] != x.ids[None, :]
        i, j = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(i):
            continue
        score = products(a, x, use[i], j)
        scored += score.size
        for w in range(low.shape[1]):
            best.add(use[i], w, score, (meets[w] & wanted)[np.ix_(i, j)], x.ids[j])
    return best, scored


FOUND = "block long, pos int, w int, score long, vec_id long"


def _cell(k: int, same_label: bool):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, out = [_Block(r) for r in rows.itertuples()], []
        for r in anchors.itertuples() if blocks else ():
            a = _Block(r)
            number = max(o["w"] for o in r.windows) + 1
            low, high = np.full((len(a.ids), number), FAR), np.full((len(a.ids), number), -FAR)
            for o in r.windows:
                low[o["pos"], o["w"]], high[o["pos"], o["w"]] = o["low"], o["high"]
            best, _ = search_block(a, low, high, blocks, k, same_label)
            pos, w, rank = np.nonzero(best.score > -FAR)
            out.append(pd.DataFrame({"block": r.block, "pos": pos, "w": w, "score": best.score[pos, w, rank], "vec_id": best.ids[pos, w, rank]}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype("int64")

    return run


def search(anchors: DataFrame, windows: DataFrame, blocks: DataFrame, k: int, same_label: bool, grid: tuple[int, int]) -> DataFrame:
    """FOUND: of each window (block, pos, w, low, high) the k best rows of all blocks; rows of each cell first."""
    groups, slabs = grid
    listed = windows.groupBy("block").agg(F.collect_list(F.struct("pos", "w", "low", "high")).alias("windows"))
    left = anchors.join(listed, "block").withColumns(
        {"g": F.pmod("slab", F.lit(groups)), "s": F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))}
    )
    right = blocks.withColumns(
        {"s": F.pmod("slab", F.lit(slabs)).cast("int"), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))}
    )
    key = ["g", "s"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_cell(k, same_label), FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window with their ranks."""
    order = Window.partitionBy("block", "pos", "w").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_rows(anchors: DataFrame, windows: DataFrame, blocks: DataFrame, k: int, same_label: bool, grid: tuple[int, int], name: str) -> DataFrame:
    """The k best rows of each window among all blocks."""
    first = blocks.filter(F.pmod("slab", F.lit(grid[1])) % PROBE == 0)
    reached = (
        top(search(anchors, windows, first, k, same_label, grid), k)
        .groupBy("block", "pos", "w")
        .agg(F.when(F.count("*") == k, F.min("score")).alias("reached"))
    )
    closer = windows.join(reached, ["block", "pos", "w"], "left").withColumn("low", F.greatest("low", "reached"))
    return written(top(search(anchors, closer, blocks, k, same_label, grid), k), name)


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all rows where `anchor` holds.

    A positive's negatives have scores from low to high times its own, both as fractions."""
    spark = vectors.sparkSession
    rows = usable(vectors, label)
    references = pick_references(rows)
    measured = rows.mapInArrow(
        _measured(references),
        "vec_id long, label long, near int, angle double, norm double, angles binary, vector binary",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = pack(measured.filter(anchor), max(1, parts // 8), ANCHORS, len(references), "anchors")
    blocks = pack(measured, parts, ROWS, len(references), "blocks")
    n_anchors, n_blocks = anchors.count(), blocks.count()
    grid = (max(1, -(-n_anchors // CELL_ANCHORS)), max(1, -(-n_blocks // CELL_ROWS), min(n_blocks, parts)))

    each = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")
    everything = {"w": F.lit(0), "low": F.lit(1 - FAR).cast("long"), "high": F.lit(FAR - 1).cast("long")}
    found = best_rows(anchors, anchors.select("block", each).withColumns(everything), blocks, positives, True, grid, "positives")

    score = F.col("score")
    windows = found.select(
        "block", "pos", (F.col("rank") - 1).cast("int").alias("w"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
        # Whole numbers only: x // y rounds down, -(-x // y) up.
        (-_floor_div(-score * low[0], low[1])).alias("low"), _floor_div(score * high[0], high[1]).alias("high"),
    ).filter("low <= high")
    mined = best_rows(anchors, windows.select("block", "pos", "w", "low", "high"), blocks, negatives, False, grid, "negatives")
    ids = anchors.select("block", "ids").mapInPandas(_anchor_ids, "block long, pos int, anchor_id long")
    return (
        mined.join(windows.drop("low", "high"), ["block", "pos", "w"])
        .join(ids, ["block", "pos"])
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _floor_div(a: Column, b: int) -> Column:
    """a divided by a positive whole number, rounded down, without leaving whole numbers."""
    by = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, by), by)


def _anchor_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for number, ids in zip(batch["block"], batch["ids"], strict=True):
            own = np.frombuffer(ids, "<i8")
            yield pd.DataFrame({"block": number, "pos": np.arange(len(own), dtype=np.int32), "anchor_id": own})
