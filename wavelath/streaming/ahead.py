"""Operators on streams that look ahead: medians, filters around their centre, regressions over neighbours.

A place is given out once all rows up to its last neighbour have come. Rows come out of order, but not later than the
watermark allows, and places of a sequence rise with time: what is as old as the watermark is complete. A sequence's state
is the rows that are still needed, those of one window and of the watermark's delay. Where nothing comes for so long that
the watermark passes a sequence's last row by idle, its end is given out as the end of a sequence, and its state goes; rows
behind that begin a sequence anew.

So a stream gives what the table gives, however its rows are cut into triggers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import bases
from ..functions.columns import require

STATE = "next long, last long, places array<long>, times array<long>, values array<double>"


def around(stream: DataFrame, left: int, right: int, run: Callable[[np.ndarray], np.ndarray], late: str, idle_ms: int, time: str = "ts", hold: bool = False, width: int = 0) -> DataFrame:
    """(seq, n, x) of a stream (seq, n, x, and its time), where run(values) gives, of a stretch of places with left ones before and right ones behind it, its values.

    Places without a row, null samples and what lies outside of a sequence are NaN; with hold, the first and the last sample
    are repeated outside. With a width, values are vectors.
    """

    def run_key(key, frames, state):
        if state.exists:
            at, last, *lists = state.get
            places, times, values = (np.array(v, kind) for v, kind in zip(lists, (np.int64, np.int64, float), strict=True))
        else:
            at, last = 0, -1
            places, times, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        over = state.hasTimedOut
        if not over:
            rows = pd.concat(list(frames))
            places = np.concatenate([places, rows["n"].to_numpy(np.int64)])
            times = np.concatenate([times, rows["ms"].to_numpy(np.int64)])
            values = np.concatenate([values, rows["x"].to_numpy(float)])
            order = np.argsort(places, kind="stable")
            places, times, values = places[order], times[order], values[order]
        watermark = state.getCurrentWatermarkMs()
        sure = int(places[times <= watermark].max(initial=-1))  # no row up to here is still to come
        last = max(last, int(places.max(initial=-1)))
        end = last + 1 if over else max(at, sure - right + 1)
        if end > at:
            x = np.full(left + end - at + right, np.nan)
            own = (places >= at - left) & (places < end + right)
            x[places[own] - at + left] = values[own]
            if hold:
                if at < left:
                    x[: left - at] = x[left - at]
                if over:
                    x[left + end - at :] = x[left + end - at - 1]
            y = run(x)
            yield pd.DataFrame({"seq": [key[0]] * (end - at), "n": np.arange(at, end), "x": list(y) if width else y})
        if over:
            state.remove()
            return
        kept = places >= end - left
        state.update((end, last, places[kept].tolist(), times[kept].tolist(), values[kept].tolist()))
        state.setTimeoutTimestamp(max(int(times.max(initial=0)) + idle_ms, watermark + 1))

    kind = stream.schema["seq"].dataType.simpleString()
    ms = F.unix_millis(F.col(time))
    rows = stream.withWatermark(time, late).select("seq", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"), ms.alias("ms"), F.col(time).alias("_time"))
    return rows.groupBy("seq").applyInPandasWithState(run_key, f"seq {kind}, n long, x {'array<double>' if width else 'double'}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windows_of(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)


def medfilt(stream: DataFrame, filter_length: int, late: str, idle_ms: int, time: str = "ts") -> DataFrame:
    """The median of a window around each place, cut at the ends; places without a sample are left out of it."""
    require(filter_length_is_positive=filter_length > 0)

    def run(x: np.ndarray) -> np.ndarray:
        kept = np.sort(windows_of(x, filter_length), axis=1)
        count = (~np.isnan(kept)).sum(axis=1)
        at, rows = np.maximum(count - 1, 0), np.arange(len(kept))
        return np.where(count > 0, 0.5 * (kept[rows, at // 2] + kept[rows, (at + 1) // 2]), np.nan)

    return around(stream, filter_length // 2, (filter_length - 1) // 2, run, late, idle_ms, time)


def fir(stream: DataFrame, taps, ahead: int, late: str, idle_ms: int, time: str = "ts") -> DataFrame:
    """y[n] = sum of taps[k] * x[n - k + ahead]; places without a sample count as zeros."""
    taps = np.asarray(taps, float)
    return around(stream, len(taps) - 1 - ahead, ahead, lambda x: np.convolve(np.nan_to_num(x), taps, "valid"), late, idle_ms, time)


def delta(stream: DataFrame, late: str, idle_ms: int, seed=((-0.5, 0, 0.5), (1, -2, 1)), static_out: bool = True, time: str = "ts") -> DataFrame:
    """(seq, n, x vector): the value and its regressions over the neighbours; the ends are repeated."""
    weights = bases.delta_windows([list(s) if isinstance(s, (list, tuple)) else s for s in seed], static_out)
    half = (weights.shape[1] - 1) // 2
    return around(stream, half, half, lambda x: windows_of(np.nan_to_num(x), 2 * half + 1) @ weights.T, late, idle_ms, time, hold=True, width=len(weights))
