"""Neighbourhoods of pixels: moving windows over tiles with rims, and nearest values for pixels without data.

A moving window is worked out tile by tile.  A pixel within reach of a tile's border is also sent to the tile beyond it,
so each tile has the rim it needs in one shuffle whose extra rows grow with the rims and not with the window.

Filling takes the nearest pixel with data by straight distance in cells, exactly: first down each column (the nearest
value above or below), then along each row over what the columns found, which is far enough for the nearest of all.
"""

from __future__ import annotations

from collections.abc import Callable
from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.raster import PIXEL, valid

#: Side of a tile, and values of windows that are held at a time.
TILE, HELD = 256, 4_000_000


def _statistic(name: str) -> Callable[[np.ndarray], np.ndarray]:
    """A statistic over the last axis of windows, NaN for absent values; windows hold one value at least."""
    return {
        "mean": lambda w: np.nanmean(w, -1),
        "sum": lambda w: np.nansum(w, -1),
        "min": lambda w: np.nanmin(w, -1),
        "max": lambda w: np.nanmax(w, -1),
        "range": lambda w: np.nanmax(w, -1) - np.nanmin(w, -1),
        "std": lambda w: np.nanstd(w, -1),
        "median": lambda w: np.nanmedian(w, -1),
        "count": lambda w: (~np.isnan(w)).sum(-1).astype(float),
    }[name]


STATISTICS = ("mean", "sum", "min", "max", "range", "std", "median", "count")


def _windows(cells: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, weights: np.ndarray | None, statistic: str) -> np.ndarray:
    """The statistic at places of a tile whose array has a rim of k // 2 cells."""
    views = np.lib.stride_tricks.sliding_window_view(cells, (k, k))
    out, step = np.empty(len(rows)), max(1, HELD // (k * k))
    for i in range(0, len(rows), step):
        w = views[rows[i : i + step], cols[i : i + step]].reshape(-1, k * k)
        if weights is None:
            out[i : i + step] = _statistic(statistic)(w)
        else:
            known = ~np.isnan(w)
            total = (known * weights).sum(-1)
            mean = np.where(known, w, 0.0) @ weights / np.where(total == 0, 1.0, total)
            out[i : i + step] = np.where(total == 0, np.nan, mean)
    return out


def focal(
    pixels: DataFrame,
    size: int = 3,
    statistic: str = "mean",
    nodata: float | None = None,
    weights: Seq[Seq[float]] | None = None,
    gaps: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """The statistic of the valid pixels in the window of ``size`` cells around each valid pixel.

    ``weights`` (size x size) gives the weighted mean instead; weights of absent pixels do not count, and a window
    whose weights add up to 0 has no row.  ``gaps`` also gives pixels without data the value of their window.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("the window must have an odd number of cells")
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic}")
    w = None if weights is None else np.asarray(weights, dtype=float)
    if w is not None and w.shape != (size, size):
        raise ValueError("weights must be size x size")
    flat, reach = None if w is None else w.ravel(), size // 2

    def tiles(axis: str):
        low = F.greatest(F.floor((F.col(axis) - reach) / tile), F.lit(0).cast("long"))
        return F.sequence(low, F.floor((F.col(axis) + reach) / tile))

    d = pixels.select(*PIXEL).withColumn("value", F.when(valid(F.col("value"), nodata), F.col("value").cast("double")))
    d = d.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        top, left = int(part["_tr"].iloc[0]) * tile, int(part["_tc"].iloc[0]) * tile
        row, col, value = part["row"].to_numpy() - top, part["col"].to_numpy() - left, part["value"].to_numpy(float)
        cells = np.full((tile + 2 * reach, tile + 2 * reach), np.nan)
        cells[row + reach, col + reach] = value
        own = (row >= 0) & (row < tile) & (col >= 0) & (col < tile)
        own &= True if gaps else ~np.isnan(value)
        at = part.loc[own, list(PIXEL)]
        if gaps and len(at):
            views = np.lib.stride_tricks.sliding_window_view(~np.isnan(cells), (size, size))
            held = views[row[own], col[own]].any((-1, -2))
            at = at.loc[held]
        found = _windows(cells, at["row"].to_numpy() - top, at["col"].to_numpy() - left, size, flat, statistic)
        return at.assign(value=found).loc[~np.isnan(found)]

    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {'double' if c == 'value' else kinds[c]}" for c in PIXEL)
    return d.groupBy("raster_id", "band", "_tr", "_tc").applyInPandas(one, schema)


def fill_nodata(pixels: DataFrame, grids: DataFrame, max_distance: float | None = None) -> DataFrame:
    """All cells of the grids: those without data take the value of the nearest one that has some.

    Distance is straight, in cells; of equally near ones the upper, then the left one counts.  Cells further than
    ``max_distance`` from any data have no row, and neither have rasters without any.  A task holds one column or row.
    """
    shape = grids.select("raster_id", F.col("ncols").cast("int").alias("_nc"), F.col("nrows").cast("int").alias("_nr"), F.col("nodata").alias("_nd"))
    d = pixels.select(*PIXEL).join(shape, "raster_id").filter(valid(F.col("value"), F.col("_nd")))
    d = d.filter("row >= 0 and col >= 0 and row < _nr and col < _nc").drop("_nd").withColumn("value", F.col("value").cast("double"))
    kinds = dict(d.dtypes)
    farthest = np.inf if max_distance is None else float(max_distance) ** 2

    def column(part: pd.DataFrame) -> pd.DataFrame:
        """For every row of one column the nearest pixel with data, the upper one of two."""
        part = part.sort_values("row").drop_duplicates("row")
        rows, values, n = part["row"].to_numpy(), part["value"].to_numpy(), int(part["_nr"].iloc[0])
        at = np.arange(n)
        after = np.searchsorted(rows, at)
        above, below = np.maximum(after - 1, 0), np.minimum(after, len(rows) - 1)
        take = np.where(np.abs(rows[above] - at) <= np.abs(rows[below] - at), above, below)
        out = pd.DataFrame({"raster_id": part["raster_id"].iloc[0], "band": part["band"].iloc[0], "row": at, "col": part["col"].iloc[0],
                            "from_row": rows[take], "value": values[take], "_nc": part["_nc"].iloc[0]})
        return out.loc[(out["from_row"] - out["row"]) ** 2 <= farthest]

    def along(part: pd.DataFrame) -> pd.DataFrame:
        """For every cell of one row the nearest of what the columns found, by looking further to both sides."""
        n, row = int(part["_nc"].iloc[0]), int(part["row"].iloc[0])
        col = part["col"].to_numpy()
        drop = np.full(n, np.inf)
        source, value = np.zeros(n, np.int64), np.zeros(n)
        drop[col] = (part["from_row"].to_numpy() - row).astype(float) ** 2
        source[col], value[col] = part["from_row"].to_numpy(), part["value"].to_numpy()
        best, best_row, best_col, out = drop.copy(), source.copy(), np.arange(n), value.copy()
        for k in range(1, n):
            # Nothing k columns away is nearer than k.
            if k * k > min(farthest, best.max()):
                break
            for to, frm in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                off = drop[frm] + k * k
                cols = np.arange(n)[frm]
                equal = (off == best[to]) & np.isfinite(off)
                first = (source[frm] < best_row[to]) | ((source[frm] == best_row[to]) & (cols < best_col[to]))
                nearer = (off < best[to]) | (equal & first)
                best[to] = np.where(nearer, off, best[to])
                best_row[to] = np.where(nearer, source[frm], best_row[to])
                best_col[to] = np.where(nearer, cols, best_col[to])
                out[to] = np.where(nearer, value[frm], out[to])
        held = best <= farthest
        held &= np.isfinite(best)
        return pd.DataFrame({"raster_id": part["raster_id"].iloc[0], "band": part["band"].iloc[0], "row": row, "col": np.arange(n)[held], "value": out[held]})

    key = f"raster_id {kinds['raster_id']}, band {kinds['band']}, row int, col int"
    down = d.groupBy("raster_id", "band", "col").applyInPandas(column, f"{key}, from_row int, value double, _nc int")
    return down.groupBy("raster_id", "band", "row").applyInPandas(along, f"{key}, value double")
