"""Sequences in long form: rows of (seq, n, x), n counted from 0.

Every operator here is joins, aggregations and projections keyed by sequence
and place, so that one long sequence is spread over all tasks. An output that
depends on several inputs is made by scatter: each sample is sent to the places
that need it, and an aggregation by (seq, place) gathers at most a window's
width of rows. Filters of any number of taps, medians and lines between samples
work in blocks with a halo (blocks.py). Nothing gathers a whole sequence.

What runs along a whole sequence (the last valid sample, a running sum) is done
in blocks: inside each block by a window over (seq, block), between blocks over
one row for each block.

x may be null: a null sample takes part in nothing and its place counts as
empty. seq may be null: that is a sequence like any other. Rows repeated for one place are each counted. A sequence without rows
has no output.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import numbers, require, zeros
from . import blocks
from .blocks import joined, lengths

#: Places of a block for what runs along a sequence.
BLOCK = 65_536
MODES = ("constant", "reflect", "replicate", "circular")


def steps(low: Column, high: Column, step: int = 1) -> Column:
    """The whole numbers from low to high; none where high is smaller."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def padded(samples: DataFrame, left: int, right: int | Column, mode: str = "constant", sizes: DataFrame | None = None) -> DataFrame:
    """(seq, n, x, length) with the places outside the sequence, from -left to length + right - 1, filled by the rule; constant leaves them out."""
    require(**{f"mode_is_one_of_{'_'.join(MODES)}": mode in MODES})
    both = joined(samples, sizes if sizes is not None else lengths(samples), ["seq"])
    if mode == "constant":
        return both.select("seq", "n", "x", "length")
    right = F.lit(right) if isinstance(right, int) else right
    n, size = F.col("n"), F.col("length")
    if mode == "replicate":
        before = F.when(n == 0, steps(F.lit(-left).cast("long"), F.lit(-1).cast("long")))
        after = F.when(n == size - 1, steps(size, size + right - 1))
    elif mode == "reflect":
        before = F.when((n >= 1) & (n <= left), F.array(-n))
        after = F.when((n <= size - 2) & (n >= size - 1 - right), F.array(2 * (size - 1) - n))
    else:
        before = F.when(n - size >= -left, F.array(n - size))
        after = F.when(n < right, F.array(n + size))
    none = F.array().cast("array<bigint>")
    places = F.concat(F.array(n), F.coalesce(before, none), F.coalesce(after, none))
    return both.select("seq", F.explode(places).alias("n"), "x", "length")


def frame(samples: DataFrame, frame_length: int, frame_period: int, center: bool = True, zmean: bool = False, mode: str = "constant") -> DataFrame:
    """(seq, t, x): overlapping frames as vectors. Frame t begins at sample t * period, less half a frame if centred."""
    require(frame_length_is_positive=frame_length > 0, frame_period_is_positive=frame_period > 0)
    left = frame_length // 2 if center else 0
    right = frame_length - 1 - left
    filled = padded(samples, left, right, mode)
    at = F.col("n") + left  # the place counted from the beginning of frame 0
    first = F.greatest(F.ceil((at - (frame_length - 1)) / F.lit(frame_period)), F.lit(0)).cast("long")
    last = F.least(F.floor(at / F.lit(frame_period)), F.ceil(F.col("length") / F.lit(frame_period)) - 1).cast("long")
    sent = filled.select("seq", "x", at.alias("at"), F.explode(steps(first, last)).alias("t")).select("seq", "t", (F.col("at") - F.col("t") * frame_period).cast("int").alias("j"), "x")
    gathered = sent.groupBy("seq", "t").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("own"))
    begin, end = F.get(F.col("own"), F.lit(0))["j"], F.element_at("own", -1)["j"]
    x = F.concat(zeros(begin), F.transform("own", lambda s: s["x"]), zeros(frame_length - 1 - end))
    if zmean:
        x = F.transform(x, lambda v: v - F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / frame_length)
    return gathered.select("seq", "t", x.alias("x"))


def unframe(frames: DataFrame, frame_length: int, frame_period: int, center: bool = True, window: str | int = "rectangular", norm: str | int = "none", symmetric: bool = True, out_length: int | None = None) -> DataFrame:
    """(seq, n, x) of frames (seq, t, x) by overlap and add, weighted by the window."""
    weights = numbers(bases.window_values(frame_length, window, norm, symmetric))
    left = frame_length // 2 if center else 0
    sent = frames.select("seq", "t", F.posexplode(F.arrays_zip(F.col("x").alias("x"), weights.alias("w"))).alias("j", "s"))
    placed = sent.select("seq", (F.col("t") * frame_period + F.col("j") - left).alias("n"), F.col("s.x").alias("x"), F.col("s.w").alias("w")).filter("n >= 0")
    if out_length is not None:
        placed = placed.filter(F.col("n") < out_length)
    return placed.groupBy("seq", "n").agg((F.sum(F.col("x") * F.col("w")) / (F.sum(F.col("w") * F.col("w")) + 1e-16)).alias("x"))


def delay(samples: DataFrame, start: int, keeplen: bool = False) -> DataFrame:
    """Later by start, zeros in front; a negative start moves to the front. keeplen keeps the length."""
    if start == 0:
        return samples
    sizes = lengths(samples)
    moved = joined(samples, sizes, ["seq"]).select("seq", (F.col("n") + start).alias("n"), "x", "length").filter("n >= 0")
    moved = (moved.filter("n < length") if keeplen else moved).select("seq", "n", "x")
    count = F.least(F.lit(abs(start)).cast("long"), F.col("length")) if keeplen else F.lit(abs(start)).cast("long")
    if start > 0:
        filler = steps(F.lit(0).cast("long"), count - 1)
    elif keeplen:
        filler = steps(F.col("length") - count, F.col("length") - 1)
    else:
        return moved
    return moved.unionByName(sizes.select("seq", F.explode(filler).alias("n"), F.lit(0.0).alias("x")))


def decimate(samples: DataFrame, period: int, start: int = 0) -> DataFrame:
    require(period_is_positive=period > 0)
    return samples.filter((F.col("n") >= start) & ((F.col("n") - start) % period == 0)).select("seq", ((F.col("n") - start) / period).cast("long").alias("n"), "x")


def interpolate(samples: DataFrame, period: int, start: int = 0) -> DataFrame:
    """Zeros put in between: sample n goes to start + n * period."""
    require(period_is_positive=period > 0)
    own = samples.select("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long"))).alias("j"), "n", "x")
    body = own.select("seq", (F.col("n") * period + F.col("j") + start).alias("n"), F.when(F.col("j") == 0, F.col("x")).otherwise(0.0).alias("x"))
    head = samples.select("seq").distinct().select("seq", F.explode(steps(F.lit(0).cast("long"), F.lit(start - 1).cast("long"))).alias("n"), F.lit(0.0).alias("x"))
    return body if start <= 0 else body.unionByName(head)


def linear_intpl(samples: DataFrame, upsampling_factor: int) -> DataFrame:
    """Lines from each sample to the next; the last value is held."""
    p = upsampling_factor
    require(upsampling_factor_is_positive=p > 0)

    def run(block: blocks.Block) -> np.ndarray:
        x = block.values(0, 1, hold_end=1)
        return (x[:-1, None] + np.diff(x)[:, None] * (np.arange(p) / p)).reshape(-1)

    return blocks.each(samples, 0, 1, run, scale=p)


def carried(rows: DataFrame, value: Column, name: str, forward: bool = True, block: int = BLOCK) -> DataFrame:
    """rows with the last value at or before each place (or the next one at or after it), nulls passed over."""
    place = F.floor(F.col("n") / F.lit(block)).cast("long")
    held = rows.withColumn("_block", place).withColumn("_value", value)
    order = F.col("n") if forward else -F.col("n")
    step = F.col("_block") if forward else -F.col("_block")
    ends = held.filter(F.col("_value").isNotNull()).groupBy("seq", "_block").agg((F.max_by if forward else F.min_by)("_value", "n").alias("_end"))
    blocks = joined(held.select("seq", "_block").distinct(), ends, ["seq", "_block"], "left")
    before = blocks.select("seq", "_block", F.last("_end", ignorenulls=True).over(W.partitionBy("seq").orderBy(step).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = F.last("_value", ignorenulls=True).over(W.partitionBy("seq", "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return joined(held, before, ["seq", "_block"]).withColumn(name, F.coalesce(inside, "_carried")).drop("_block", "_value", "_carried")


def running_sum(rows: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of all values up to each place."""
    held = rows.withColumn("_block", F.floor(F.col("n") / F.lit(block)).cast("long")).withColumn("_value", value)
    sums = held.groupBy("seq", "_block").agg(F.sum("_value").alias("_sum"))
    before = sums.select("seq", "_block", F.coalesce(F.sum("_sum").over(W.partitionBy("seq").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy("seq", "_block").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return joined(held, before, ["seq", "_block"]).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0.0))).drop("_block", "_value", "_before")


def magic_intpl(samples: DataFrame, magic_number: float = 0, block: int = BLOCK) -> DataFrame:
    """Runs of the magic number become a line between their neighbours; at the ends the nearest valid value is held."""
    valid = F.when(F.col("x") != magic_number, F.struct("n", "x"))
    both = carried(carried(samples, valid, "left", True, block), valid, "right", False, block)
    share = (F.col("n") - F.col("left.n")) / F.nullif(F.col("right.n") - F.col("left.n"), F.lit(0).cast("long"))
    line = F.col("left.x") + (F.col("right.x") - F.col("left.x")) * share
    filled = F.when(F.col("x") != magic_number, F.col("x")).otherwise(F.coalesce(line, "left.x", "right.x", "x"))
    return both.select("seq", "n", filled.alias("x"))


def medfilt(samples: DataFrame, filter_length: int, magic_number: float | None = None) -> DataFrame:
    """Median of a window cut at the ends; where the magic number is in the strict majority the result is magic. Windows without a sample give null."""
    require(filter_length_is_positive=filter_length > 0)
    left, right = filter_length // 2, (filter_length - 1) // 2

    def median(window: np.ndarray) -> np.ndarray:
        """Of each row, NaN left out."""
        kept = np.sort(window, axis=1)
        count = (~np.isnan(kept)).sum(1)
        at = np.maximum(count - 1, 0)
        rows = np.arange(len(kept))
        return np.where(count > 0, 0.5 * (kept[rows, at // 2] + kept[rows, (at + 1) // 2]), np.nan)

    def run(block: blocks.Block) -> np.ndarray:
        total = left + block.count + right
        valid = ~np.isnan(block.x)
        at, x = (block.n - block.begin + left)[valid], block.x[valid]
        inside = (at >= 0) & (at < total)
        at, x = at[inside], x[inside]
        most = int(np.bincount(at).max()) if len(at) else 1  # rows repeated for one place
        held = np.full((total, most), np.nan)
        held[at, np.arange(len(at)) - np.searchsorted(at, at)] = x
        out = []
        for k in range(0, block.count, 1024):
            part = held[k : min(k + 1024, block.count) + left + right]
            window = np.lib.stride_tricks.sliding_window_view(part, left + right + 1, axis=0).reshape(len(part) - left - right, -1)
            if magic_number is None:
                out.append(median(window))
            else:
                magic = window == magic_number
                count = (~np.isnan(window)).sum(1)
                out.append(np.where(2 * magic.sum(1) > count, magic_number, median(np.where(magic, np.nan, window))))
        return np.concatenate(out)

    return blocks.each(samples, left, right, run)


def delta(samples: DataFrame, seed=((-0.5, 0, 0.5), (1, -2, 1)), static_out: bool = True) -> DataFrame:
    """(seq, n, x vector): the value and its regressions over the neighbours; the ends are repeated."""
    windows = bases.delta_windows([list(s) if isinstance(s, (list, tuple)) else s for s in seed], static_out)
    half = (windows.shape[1] - 1) // 2
    filled = padded(samples, half, half, "replicate")
    reach = F.explode(F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long")))
    sent = filled.select("seq", "n", "x", "length", reach.alias("i")).select("seq", (F.col("n") + F.col("i")).alias("m"), (half - F.col("i")).cast("int").alias("j"), "x", "length").filter("m >= 0 AND m < length")
    rows = [F.sum(F.col("x") * F.get(numbers(w), F.col("j"))) for w in windows]
    return sent.groupBy("seq", F.col("m").alias("n")).agg(F.array(*rows).alias("x"))


def fir(samples: DataFrame, taps, left: int | None = None, hold_end: int = 0) -> DataFrame:
    """y[n] = sum of taps[k] * x[n - k + ahead], ahead = len(taps) - 1 - left, in blocks; several rows of taps give vectors. hold_end repeats the last sample."""
    taps = np.atleast_2d(np.asarray(taps, float))
    last = taps.shape[1] - 1
    ahead = 0 if left is None else last - left

    def run(block: blocks.Block) -> np.ndarray:
        y = blocks.convolved(block.values(last - ahead, ahead, hold_end), taps)
        return y if len(taps) > 1 else y[:, 0]

    return blocks.each(samples, last - ahead, ahead, run, vectors=len(taps) > 1)


def zcross(samples: DataFrame, frame_length: int, norm: bool = False, softness: float = 1e-3) -> DataFrame:
    """(seq, t, x): soft zero crossings of each whole block; the first sample has no step before it."""
    soft = F.tanh(F.col("x") / softness)
    both = samples.select("seq", F.explode(F.array(F.struct(F.col("n").alias("n"), soft.alias("here"), F.lit(None).cast("double").alias("before")), F.struct((F.col("n") + 1).alias("n"), F.lit(None).cast("double").alias("here"), soft.alias("before")))).alias("s")).select("seq", "s.*")
    steps_ = both.groupBy("seq", "n").agg(F.max("here").alias("here"), F.max("before").alias("before")).filter("here IS NOT NULL")
    size = F.abs(F.col("here") - F.coalesce("before", "here"))
    scale = 0.5 / frame_length if norm else 0.5
    whole = steps_.groupBy("seq", F.floor(F.col("n") / frame_length).cast("long").alias("t")).agg((F.sum(size) * scale).alias("x"), F.count("*").alias("own"))
    return whole.filter(F.col("own") == frame_length).select("seq", "t", "x")


def histogram(samples: DataFrame, n_bin: int = 10, lower_bound: float = 0, upper_bound: float = 1, norm: bool = False, softness: float = 1e-3) -> DataFrame:
    """(seq, x vector): soft counts of each sequence's values; one partial sum for each bin, so that only sums are shuffled."""
    width = (upper_bound - lower_bound) / n_bin
    sigmoid = lambda z: 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -z))))
    edge = lambda k: sigmoid((F.col("x") - (lower_bound + k * width)) / softness)
    sums = [F.sum(edge(k) - edge(k + 1)).alias(f"b{k}") for k in range(n_bin)]
    counted = samples.groupBy("seq").agg(*sums)
    bins = F.array(*[F.col(f"b{k}") for k in range(n_bin)])
    if norm:
        bins = F.transform(bins, lambda v: v / F.nullif(F.aggregate(bins, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))
    return counted.select("seq", bins.alias("x"))


def flux(frames: DataFrame, lag: int = 1, norm: float = 2, reduction: str = "mean", other: DataFrame | None = None) -> DataFrame:
    """Distances of each frame x[t] to y[t - lag] (y is x itself by default): rows for none, else one row."""
    y = (frames if other is None else other).select("seq", (F.col("t") + lag).alias("t"), F.col("x").alias("y"))
    gaps = F.zip_with("x", "y", lambda a, b: F.pow(F.abs(a - b), F.lit(float(norm))))
    each = joined(frames, y, ["seq", "t"]).select("seq", "t", F.pow(F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b), F.lit(1 / norm)).alias("flux"), F.size("x").alias("dims"))
    if reduction == "none":
        return each.select("seq", (F.col("t") - max(lag, 0)).alias("t"), "flux")
    result = {"sum": F.sum("flux"), "batchmean": F.avg("flux"), "mean": F.avg("flux") / F.pow(F.max("dims"), F.lit(1 / norm))}
    return each.agg(result[reduction].alias("flux"))
