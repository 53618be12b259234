"""Distances and scores of pairs: aggregations with partial sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import batched, col, require, tail


def square_error(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def reduced(each: DataFrame, name: str, reduction: str, mean: Column | None = None) -> DataFrame:
    """each as it is for none, else one row with its sum or mean."""
    if reduction == "none":
        return each
    result = {"sum": F.sum(name), "batchmean": F.avg(name), "mean": mean if mean is not None else F.avg(name)}
    require(reduction_is_none_sum_mean_or_batchmean=reduction in result)
    return each.agg(result[reduction].alias(name))


def rmse(pairs: DataFrame, reduction: str = "mean", x: str = "x", y: str = "y") -> DataFrame:
    """Root mean square errors of vector pairs."""
    return reduced(pairs.withColumn("rmse", F.sqrt(square_error(F.col(x), F.col(y)) / F.size(x))).drop(x, y), "rmse", reduction)


def cdist(pairs: DataFrame, full: bool = False, reduction: str = "mean", x: str = "x", y: str = "y") -> DataFrame:
    """Cepstral distances without the gain; mean is also over the root of the order, batchmean is not; full is in dB."""
    scale = 10 * math.sqrt(2) / math.log(10) if full else 1.0
    each = pairs.withColumn("cdist", F.sqrt(square_error(tail(F.col(x)), tail(F.col(y)))) * scale).withColumn("_order", F.size(x) - 1).drop(x, y)
    mean = F.avg("cdist") / F.sqrt(F.max("_order"))
    return reduced(each, "cdist", reduction, mean).drop("_order")


def snr(pairs: DataFrame, frame_length: int | None = None, full: bool = False, reduction: str = "mean", eps: float = 1e-8) -> DataFrame:
    """Log signal-to-noise ratios of (seq, n, s, sn), by sequence or by whole blocks of frame_length; full is in dB."""
    part = ["seq"] if frame_length is None else ["seq", "t"]
    rows = pairs if frame_length is None else pairs.withColumn("t", F.floor(F.col("n") / frame_length).cast("long"))
    sums = rows.groupBy(*part).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum((F.col("sn") - F.col("s")) * (F.col("sn") - F.col("s"))).alias("n2"), F.count("*").alias("own"))
    if frame_length is not None:
        sums = sums.filter(F.col("own") == frame_length)
    each = sums.select(*part, (F.log10((F.col("s2") + eps) / (F.col("n2") + eps)) * (10 if full else 1)).alias("snr"))
    return reduced(each, "snr", reduction)


F0_FORMATS = ("f0-rmse-hz", "f0-rmse-cent", "f0-rmse-semitone", "vuv-error-rate", "vuv-error-percent", "vuv-macro-f1-score")


def f0eval(pairs: DataFrame, reduction: str = "mean", out_format: str = "f0-rmse-cent") -> DataFrame:
    """Errors of pitch tracks (seq, t, x, y), 0 where unvoiced. The errors in pitch are over all frames voiced in both; the scores are by sequence."""
    require(out_format_is_known=out_format in F0_FORMATS)
    both = (F.col("x") != 0) & (F.col("y") != 0)
    if out_format.startswith("f0"):
        unit = {"hz": lambda v: v, "cent": lambda v: 1200 * F.log2(v), "semitone": lambda v: 12 * F.log2(v)}[out_format.rsplit("-", 1)[1]]
        gap = unit(F.col("x")) - unit(F.col("y"))
        return pairs.filter(both).agg(F.sqrt(F.avg(gap * gap)).alias("f0eval"))
    none = (F.col("x") == 0) & (F.col("y") == 0)
    counts = pairs.groupBy("seq").agg(F.count_if(both).alias("tp"), F.count_if(none).alias("tn"), F.count("*").alias("all"))
    wrong = F.col("all") - F.col("tp") - F.col("tn")
    if out_format == "vuv-macro-f1-score":
        score = lambda right: F.coalesce(2 * F.col(right) / F.nullif(2 * F.col(right) + wrong, F.lit(0)), F.lit(0.0))
        value = (score("tp") + score("tn")) / 2
    else:
        value = wrong / F.col("all") * (100 if out_format.endswith("percent") else 1)
    return reduced(counts.select("seq", value.alias("f0eval")), "f0eval", reduction)


#: The steps back (frames of x, frames of y) of each local path constraint, and whether a step along one
#: sequence alone may only follow a step along both.
DTW_STEPS = {
    0: (((1, 0), (0, 1)), False),
    1: (((1, 0), (0, 1), (1, 1)), False),
    2: (((1, 0), (1, 1)), False),
    3: (((1, 0), (1, 1), (1, 2)), False),
    4: (((1, 0), (0, 1), (1, 1)), True),
    5: (((1, 1), (1, 2), (2, 1)), False),
    6: (((1, 0), (1, 1), (1, 2)), True),
}
DTW_METRICS = ("manhattan", "euclidean", "squared-euclidean", "symmetric-kl")


def frame_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    x, y = x[:, :, None, :], y[:, None, :, :]
    if metric == "manhattan":
        return np.abs(x - y).sum(-1)
    if metric == "symmetric-kl":
        return (x * np.log(np.maximum(x / y, 1e-10)) + y * np.log(np.maximum(y / x, 1e-10))).sum(-1)
    square = ((x - y) ** 2).sum(-1)
    return np.sqrt(square) if metric == "euclidean" else square


def soft_least(options: np.ndarray, softness: float) -> np.ndarray:
    low = options.min(0)
    safe = np.where(np.isfinite(low), low, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(low), safe - softness * np.log(np.exp(-(options - safe) / softness).sum(0)), np.inf)


def warped_costs(d: np.ndarray, p: int, softness: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the best warpings of pairs up to each cell, and the number of the step by which each was reached (-1: none). Cells of one diagonal are worked out together."""
    moves, in_turn = DTW_STEPS[p]
    count, m, n = d.shape
    # after a step along both sequences, and after any
    cost = {"both": np.full(d.shape, np.inf), "any": np.full(d.shape, np.inf)}
    chosen = np.full(d.shape, -1)
    cost["any"][:, 0, 0] = d[:, 0, 0]
    along_both = [bool(s and t) for s, t in moves]
    for far in range(1, m + n - 1):
        i = np.arange(max(0, far - n + 1), min(m - 1, far) + 1)
        j = far - i
        reach = np.full((len(moves), count, len(i)), np.inf)
        for k, (s, t) in enumerate(moves):
            source = cost["both" if in_turn and not (s and t) else "any"]
            own = (i >= s) & (j >= t)
            reach[k][:, own] = source[:, i[own] - s, j[own] - t] + (s + t) * d[:, i[own], j[own]]
        cost["any"][:, i, j] = soft_least(reach, softness)
        if any(along_both):
            cost["both"][:, i, j] = soft_least(reach[along_both], softness)
        chosen[:, i, j] = np.where(np.isfinite(reach.min(0)), reach.argmin(0), -1)
    return cost["any"], chosen


#: Numbers of the largest array that a slice of pairs needs.
DTW_SLICE = 1 << 22


def in_slices(a: np.ndarray, b: np.ndarray, dims: int, metric: str):
    """Frame distances of pairs, a few pairs at a time."""
    each = max(1, a.shape[1] * b.shape[1] // max(dims, 1))
    step = max(1, DTW_SLICE // each)
    for at in range(0, len(a), step):
        x, y = (v[at : at + step].reshape(len(v[at : at + step]), -1, dims) for v in (a, b))
        yield frame_distances(x, y, metric)


def dtw(x: Column | str, y: Column | str, dims: int, metric: str | int = "euclidean", p: int = 4, softness: float = 1e-3) -> Column:
    """Soft warped distance of pairs of short sequences of frames, each one vector of frames * dims numbers; over the sum of lengths.

    A step counts as often as the frames that it advances by. A pair's table of frames by frames has to fit a task.
    """
    metric = DTW_METRICS[metric] if isinstance(metric, int) else metric

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([warped_costs(d, p, softness)[0][:, -1, -1] / (d.shape[1] + d.shape[2]) for d in in_slices(a, b, dims, metric)])

    return batched(run, col(x), col(y), returns="double")


def dtw_path(x: Column | str, y: Column | str, dims: int, metric: str | int = "euclidean", p: int = 1, softness: float = 1e-3) -> Column:
    """The best warping as places of x and y in turn, [i0, j0, i1, j1, ...], padded with -1."""
    metric = DTW_METRICS[metric] if isinstance(metric, int) else metric
    moves, _ = DTW_STEPS[p]

    def traced(d: np.ndarray) -> np.ndarray:
        _, chosen = warped_costs(d, p, softness)
        steps = np.array([*moves, (0, 0)])  # the last one for cells that nothing leads to
        rows, longest = np.arange(len(d)), d.shape[1] + d.shape[2]
        at = np.tile([d.shape[1] - 1, d.shape[2] - 1], (len(d), 1))
        path, size = np.full((len(d), longest, 2), -1.0), np.zeros(len(d), int)
        going = np.ones(len(d), bool)
        for k in range(longest):  # all pairs go back together, a step at a time
            path[going, k] = at[going]
            size[going] += 1
            step = chosen[rows, at[:, 0], at[:, 1]]
            going &= step >= 0
            if not going.any():
                break
            at = at - np.where(going[:, None], steps[step], 0)
        order = size[:, None] - 1 - np.arange(longest)
        return np.where(order[..., None] >= 0, np.take_along_axis(path, np.maximum(order, 0)[..., None], axis=1), -1.0).reshape(len(d), -1)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([traced(d) for d in in_slices(a, b, dims, metric)])

    return batched(run, col(x), col(y))
