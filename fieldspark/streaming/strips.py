"""Live strip segmentation: per vehicle the last few points and the open strip as typed state.

State lives in the store of the streaming query (RocksDB, which `plans.session.tuned` sets): a list of waiting points, a
list of the last points given out, and the open strip.  A list never holds more than ``window`` + 1 points, whatever the
vehicle sends, and silence is an event-time timer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "vehicle string, fid bigint, ts double, shot bigint, brk boolean"
_POINT = "ts double, fid bigint, x double, y double"


def _azimuth(p: list, q: list) -> float:
    return math.degrees(math.atan2(q[2] - p[2], q[3] - p[3])) % 360.0


def _mean(values: list[float]) -> float:
    s = sum(math.sin(math.radians(v)) for v in values)
    c = sum(math.cos(math.radians(v)) for v in values)
    return math.degrees(math.atan2(s, c)) % 360.0


def _breaks(points: list, i: int, window: int, severe: float, max_distance: float) -> bool:
    """Whether a strip starts at point i; points are [ts, fid, x, y]."""
    if i == 0:
        return False
    p, q = points[i - 1], points[i]
    if 0 < max_distance < math.hypot(q[2] - p[2], q[3] - p[3]):
        return True
    before = [_azimuth(points[j - 1], points[j]) for j in range(max(1, i - window), i)]
    after = [_azimuth(points[j - 1], points[j]) for j in range(i + 1, min(len(points), i + window + 1))]
    if not before or not after:
        return False
    d = abs(_mean(before) - _mean(after)) % 360.0
    return min(d, 360.0 - d) > severe


class StripProcessor(StatefulProcessor):
    """Strip numbers of one vehicle's points; points are [ts, fid, x, y] and, once given out, their strip."""

    def __init__(self, window: int, severe: float, max_distance: float, idle_seconds: int):
        self.window, self.severe, self.max_distance, self.idle_seconds = window, severe, max_distance, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _POINT)
        self.given = handle.getListState("given", _POINT + ", shot bigint")
        self.open = handle.getValueState("open", "shot bigint, newest double, due bigint")

    def _line(self) -> tuple[list, list, int, float, int | None]:
        """Points given out, waiting points, the open strip, the newest time and the timer."""
        given = [list(p) for p in self.given.get()] if self.given.exists() else []
        waiting = [list(p) for p in self.waiting.get()] if self.waiting.exists() else []
        shot, newest, due = self.open.get() if self.open.exists() else (1, float("-inf"), None)
        return given, waiting, shot, newest, due

    def _give(self, key: tuple, given: list, waiting: list, shot: int, until: int) -> tuple[list, list, int]:
        """(rows, points given out, strip) once the points before place `until` are given out."""
        waiting.sort(key=lambda p: (p[0], p[1]))
        line, rows, shots = [p[:4] for p in given] + waiting, [], [p[4] for p in given]
        for i in range(len(given), max(until, len(given))):
            brk = _breaks(line, i, self.window, self.severe, self.max_distance)
            shot += brk
            shots.append(shot)
            rows.append((key[0], line[i][1], line[i][0], shot, brk))
        done = len(shots)
        keep = slice(max(0, done - self.window - 1), done)
        last = [(*p, s) for p, s in zip(line[keep], shots[keep], strict=True)]
        _store(self.waiting, [tuple(p) for p in line[done:]])
        return rows, last, shot

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given, waiting, shot, newest, due = self._line()
        last, out = ((given[-1][0], given[-1][1]) if given else (float("-inf"), 0)), []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                p = [float(r.ts), int(r.fid), float(r.x), float(r.y)]
                newest = max(newest, p[0])
                if (p[0], p[1]) > last:
                    waiting.append(p)
                else:
                    before = [h for h in given if (h[0], h[1]) < (p[0], p[1])]
                    out.append((key[0], p[1], p[0], (before or given[:1])[-1][4], False))
        more, kept, shot = self._give(key, given, waiting, shot, len(given) + len(waiting) - self.window)
        _store(self.given, kept)
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(int((newest + self.idle_seconds) * 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.open.update((shot, newest, due))
        yield _frame(out + more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given, waiting, shot, newest, due = self._line()
        if due is None or due > expiredTimerInfo.getExpiryTimeInMs():
            # A timer that later points have put off.
            yield _frame([])
            return
        rows, _, shot = self._give(key, given, waiting, shot, len(given) + len(waiting))
        self.given.clear()
        # What comes after the silence begins the next strip.
        self.open.update((shot + (len(given) + len(rows) > 0), newest, None))
        yield _frame(rows)

    def close(self) -> None:
        pass


def _store(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    kinds = {"vehicle": "object", "fid": "int64", "ts": "float64", "shot": "int64", "brk": "bool"}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def stream_strips(
    points: DataFrame,
    window: int = 2,
    severe: float = 45.0,
    max_distance: float = 0.0,
    delay: str = "10 minutes",
    idle_seconds: int = 600,
) -> DataFrame:
    """Strip number of every point of a stream (vehicle, fid, event_time, ts, x, y).

    A point comes out once ``window`` later points are known, so output lags by
    that many points; the rest comes out when a vehicle falls silent, and what it
    sends afterwards begins the next strip.  Only the watermark makes a point late:
    one that belongs before points already given out joins the strip of the point
    before it.
    """
    processor = StripProcessor(window, severe, max_distance, idle_seconds)
    watched = points.withWatermark("event_time", delay).groupBy("vehicle")
    return watched.transformWithStateInPandas(processor, OUTPUT, "append", "EventTime")
