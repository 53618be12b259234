"""Voice analysis and synthesis: constant-Q spectra, pitch, pitch-adaptive spectra.

Frames come from sequences.py; what a frame needs beside its samples (its pitch)
is joined by (seq, t). Per-row numpy is a small kernel on one frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, require
from . import blocks
from . import sequences as seq
from .prediction import correlate, formatted


def constant_q(sample_rate: float, f_min: float, n_bin: int, n_bin_per_octave: int, tuning: float, filter_scale: float, norm: float, window: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Centre frequencies, lengths and complex filters of bins spaced evenly in pitch; every filter has unit norm."""
    centre = f_min * 2.0 ** ((np.arange(n_bin) + tuning) / n_bin_per_octave)
    # neighbouring bins meet at the edges of their bands
    ratio = 2.0 ** (2.0 / n_bin_per_octave)
    length = filter_scale * (ratio + 1) / (ratio - 1) * sample_rate / centre
    require(the_highest_bin_is_above_half_the_sample_rate=centre[-1] < sample_rate / 2)
    filters = []
    for f, size in zip(centre, length, strict=True):
        n = np.arange(int(np.floor(-size / 2)), int(np.floor(size / 2)))
        h = np.exp(2j * np.pi * n * f / sample_rate) * bases.window_values(len(n), "hanning" if window == "hann" else window, symmetric=False)
        filters.append(h / np.linalg.norm(h, norm))
    return centre, length, filters


def kernel_rows(length: np.ndarray, filters: list[np.ndarray], scale: np.ndarray) -> tuple[np.ndarray, int]:
    """The filters times scale as rows of one matrix, and the column of place 0."""
    left = max(-int(np.floor(-size / 2)) for size in length)
    right = max(len(h) + int(np.floor(-size / 2)) for h, size in zip(filters, length, strict=True))
    out = np.zeros((len(filters), left + right), complex)
    for k, (h, size) in enumerate(zip(filters, length, strict=True)):
        begin = left + int(np.floor(-size / 2))
        out[k, begin : begin + len(h)] = h * scale[k]
    return out, left


#: Numbers of the largest array that a slice of frames needs.
SLICE = 1 << 22


def cqt(
    samples: DataFrame, frame_period: int, sample_rate: float, f_min: float = 32.7, n_bin: int = 84, n_bin_per_octave: int = 12, tuning: float = 0, filter_scale: float = 1,
    norm: float = 1, window: str = "hann", scale: bool = True,
) -> DataFrame:
    """(seq, t, k, re, im): constant-Q spectrum at every frame_period, straight from its definition, in blocks that see half a filter to either side."""
    _, length, filters = constant_q(sample_rate, f_min, n_bin, n_bin_per_octave, tuning, filter_scale, norm, window)
    kernel, left = kernel_rows(length, [h.conj() for h in filters], np.sqrt(length) if scale else length)
    right = kernel.shape[1] - left
    size = -(-max(blocks.SIZE, left + right) // frame_period) * frame_period
    basis = np.concatenate([kernel.real, kernel.imag]).T

    def run(block: blocks.Block):
        if not block.count:
            return None
        x = np.lib.stride_tricks.sliding_window_view(block.values(left, right), left + right)[: block.count : frame_period]
        step = max(1, SLICE // (left + right))
        return np.arange(block.begin, block.begin + block.count, frame_period) // frame_period, np.concatenate([x[k : k + step] @ basis for k in range(0, len(x), step)])

    found = blocks.work(blocks.sent(samples, left, right, size), run, size, vectors=True)
    both = F.arrays_zip(F.slice("x", 1, n_bin).alias("re"), F.slice("x", n_bin + 1, n_bin).alias("im"))
    return found.select("seq", F.col("n").alias("t"), F.posexplode(both).alias("k", "c")).select("seq", "t", "k", "c.re", "c.im")


def flat_response(centre: np.ndarray, length: np.ndarray, filters: list[np.ndarray], sample_rate: float, frame_period: int) -> np.ndarray:
    """Weights of bins for a flat response at their centres."""
    reply = np.array([[abs(np.sum(h.conj() * np.exp(2j * np.pi * f / sample_rate * (np.arange(len(h)) + np.floor(-size / 2))))) ** 2 for h, size in zip(filters, length, strict=True)] for f in centre])
    return np.linalg.lstsq(reply, np.full(len(centre), frame_period), rcond=None)[0]


def icqt(
    spectra: DataFrame, frame_period: int, sample_rate: float, out_length: int | None = None, f_min: float = 32.7, n_bin: int = 84, n_bin_per_octave: int = 12, tuning: float = 0, filter_scale: float = 1,
    norm: float = 1, window: str = "hann", scale: bool = True,
) -> DataFrame:
    """(seq, n, x): every coefficient is sent to the samples of its filter; bins are weighted for a flat response at their centres.

    Without out_length every sequence is as long as its frames reach.
    """
    centre, length, filters = constant_q(sample_rate, f_min, n_bin, n_bin_per_octave, tuning, filter_scale, norm, window)
    weight = flat_response(centre, length, filters, sample_rate, frame_period)
    kernel, left = kernel_rows(length, filters, 2 * weight / (np.sqrt(length) if scale else length))
    right = kernel.shape[1] - left
    size = max(blocks.SIZE, left + right)
    own = spectra.groupBy("seq", "t").agg(F.collect_list(F.struct("k", "re", "im")).alias("c"))
    part = lambda name: F.transform(F.sequence(F.lit(0), F.lit(n_bin - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.transform("c", lambda v: F.struct(v["k"].cast("int"), v[name]))), k), F.lit(0.0)))
    vectors = own.select("seq", "t", F.concat(part("re"), part("im")).alias("x"))
    place = F.col("t") * frame_period
    sent = blocks.sent_vectors(vectors, place, right, left, size)
    # a sequence ends where its last frame's filters do
    ends = spectra.groupBy("seq").agg((F.max("t") * frame_period + right).cast("long").alias("length"))
    basis = np.concatenate([kernel.real, -kernel.imag])

    def run(block: blocks.Block):
        count = block.count if out_length is None else min(block.count, out_length - block.begin)
        if count <= 0 or block.vectors is None:
            return None
        y = np.zeros(left + right + size + left + right)
        step = max(1, SLICE // (left + right))
        for k in range(0, len(block.numbers), step):
            at = block.numbers[k : k + step, None] * frame_period - block.begin + right + np.arange(left + right)  # left of a frame's place lies at at - left
            inside = (at >= 0) & (at < len(y))
            np.add.at(y, at[inside], (block.vectors[k : k + step] @ basis)[inside])
        return np.arange(block.begin, block.begin + count), y[left + right : left + right + count]

    return blocks.work(blocks.joined(sent, ends, ["seq"]), run, size)



PITCH_FORMATS = ("pitch", "f0", "log-f0", "prob")


def pitch(samples: DataFrame, frame_period: int, sample_rate: float, f_min: float = 60, f_max: float = 400, threshold: float = 0.15, out_format: str = "pitch") -> DataFrame:
    """(seq, t, x): pitch of every frame by the cumulative-mean normalised difference. Stands in for neural trackers, whose weights are not to be had.

    pitch is in samples and f0 in Hz, 0 where unvoiced; log-f0 is -1e10 there; prob is how periodic the frame is.
    """
    require(out_format_is_known=out_format in PITCH_FORMATS)
    low, high = int(sample_rate / f_max), int(np.ceil(sample_rate / f_min))

    def run(v: np.ndarray) -> np.ndarray:
        size = v.shape[1]
        energy = np.cumsum(np.column_stack([np.zeros(len(v)), v * v]), axis=1)
        tau = np.arange(high + 2)
        d = energy[:, size - tau] + energy[:, [size]] - energy[:, tau] - 2 * correlate(v, high + 1)
        d = np.maximum(d, 0)
        mean = np.ones_like(d)
        mean[:, 1:] = d[:, 1:] * tau[1:] / (np.cumsum(d[:, 1:], axis=1) + 1e-12)
        span = mean[:, low : high + 1]
        deep = span < threshold
        # the first dip below the threshold, to its bottom; without one the deepest place
        first = np.where(deep.any(1), deep.argmax(1), span.argmin(1))
        for _ in range(span.shape[1]):
            ahead = np.minimum(first + 1, span.shape[1] - 1)
            fall = span[np.arange(len(v)), ahead] < span[np.arange(len(v)), first]
            if not fall.any():
                break
            first = np.where(fall, ahead, first)
        lag = first + low
        rows = np.arange(len(v))
        left, here, right = mean[rows, lag - 1], mean[rows, lag], mean[rows, lag + 1]
        bend = left - 2 * here + right
        exact = lag + np.where(np.abs(bend) > 1e-12, 0.5 * (left - right) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
        prob = np.clip(1 - here, 0, 1)
        voiced = (prob > 1 - 2 * threshold) & (energy[:, -1] > 1e-10)
        period = np.where(voiced, exact, 0.0)
        f0 = np.where(voiced, sample_rate / np.maximum(exact, 1), 0.0)
        return {"pitch": period, "f0": f0, "log-f0": np.where(voiced, np.log(np.maximum(f0, 1e-300)), -1e10), "prob": prob}[out_format]

    frames = seq.frame(samples, 2 * (high + 2) + 2, frame_period, True)
    return frames.select("seq", "t", batched(run, "x", returns="double").alias("x"))


def envelope(x: np.ndarray, f0: float, sample_rate: float, fft_length: int, q1: float = -0.15) -> np.ndarray:
    """Log magnitude of a spectral envelope freed of its pitch: a window of three periods, smoothing over the harmonics, and compensation on the cepstrum."""
    half = int(round(1.5 * sample_rate / f0))
    middle = len(x) // 2
    n = np.arange(-half, half + 1)
    w = 0.5 * np.cos(np.pi * n / (1.5 * sample_rate) * f0) + 0.5
    part = x[np.clip(middle + n, 0, len(x) - 1)] * w / np.sqrt(np.sum(w * w))
    part = part - w * np.sum(part) / np.sum(w)
    f = np.arange(fft_length // 2 + 1) * sample_rate / fft_length
    power = np.abs(np.fft.rfft(part, fft_length)) ** 2
    low = f < f0
    power[low] += np.interp(f0 - f[low], f, power)
    # mean over two thirds of the pitch, mirrored at both ends
    both = np.concatenate([power[:0:-1], power, power[-2::-1]])
    axis = (np.arange(len(both)) - len(power) + 1) * sample_rate / fft_length
    area = np.concatenate([[0], np.cumsum(0.5 * (both[1:] + both[:-1]))]) * sample_rate / fft_length
    smooth = (np.interp(f + f0 / 3, axis, area) - np.interp(f - f0 / 3, axis, area)) * 1.5 / f0
    cepstrum = np.fft.irfft(np.log(np.maximum(smooth, 1e-16)))
    quefrency = np.minimum(np.arange(fft_length), fft_length - np.arange(fft_length)) / sample_rate
    lifter = np.sinc(f0 * quefrency) * ((1 - 2 * q1) + 2 * q1 * np.cos(2 * np.pi * quefrency * f0))
    return 0.5 * np.fft.rfft(cepstrum * lifter).real


def pitch_spec(samples: DataFrame, f0: DataFrame, frame_period: int, sample_rate: float, fft_length: int, default_f0: float = 500.0, f_min: float | None = None, out_format: str | int = "power") -> DataFrame:
    """(seq, t, x): envelopes of samples (seq, n, x) at the frames of f0 (seq, t, x, in Hz); an unvoiced frame takes default_f0."""
    least = f_min or 3.0 * sample_rate / (fft_length - 3)
    size = 2 * (int(round(1.5 * sample_rate / least)) + 1)
    frames = seq.frame(samples, size, frame_period, True)
    known = f0.select("seq", "t", F.when(F.col("x") > least, F.col("x")).otherwise(default_f0).alias("f0"))

    def run(x: np.ndarray, pitch: np.ndarray) -> np.ndarray:
        return formatted(np.stack([envelope(v, p, sample_rate, fft_length) for v, p in zip(x, pitch, strict=True)]), out_format)

    return frames.join(known, ["seq", "t"]).select("seq", "t", batched(run, "x", "f0").alias("x"))


AP_FORMATS = ("a", "p", "a/p", "p/a")


def band_residuals(x: np.ndarray, f0: float, sample_rate: float, bands: int) -> np.ndarray:
    """Of each octave band, from the lowest: the share of its energy that the periods before and after do not predict."""
    size, middle = len(x), len(x) // 2
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / sample_rate)
    lag = int(round(sample_rate / f0))
    span = np.arange(middle - lag, middle + lag + 1)
    w = np.hanning(len(span) + 2)[1:-1]
    out = np.ones(bands)
    for k in range(bands):
        high = sample_rate / 2 ** (bands - k)
        band = np.fft.irfft(np.where((f <= high) & (f > (high / 2 if k else 0)), spectrum, 0), size)
        taps = np.stack([band[np.clip(span + side * lag + j, 0, size - 1)] for side in (-1, 1) for j in (-1, 0, 1)], axis=1)
        target = band[span]
        gram = (taps * w[:, None]).T @ taps
        gram += np.eye(6) * (1e-6 * np.trace(gram) + 1e-12)
        rest = target - taps @ np.linalg.solve(gram, (taps * w[:, None]).T @ target)
        out[k] = np.sqrt(np.sum(w * rest**2) / max(np.sum(w * target**2), 1e-12))
    return out


def ap(samples: DataFrame, f0: DataFrame, frame_period: int, sample_rate: float, fft_length: int, lower_bound: float = 1e-3, upper_bound: float = 0.999, f_min: float = 60.0, out_format: str = "a") -> DataFrame:
    """(seq, t, x): aperiodicity at every bin, from octave bands by prediction over neighbouring periods; f0 (seq, t, x) in Hz, 0 where unvoiced.

    a is the aperiodic share of the amplitude, p the periodic one, a/p and p/a their ratios.
    """
    require(out_format_is_known=out_format in AP_FORMATS)
    bands = max(1, int(np.log2(sample_rate / 1000)))
    centre = np.concatenate([[0.0], 0.75 * sample_rate / 2.0 ** np.arange(bands, 0, -1), [sample_rate / 2]])
    bins = np.arange(fft_length // 2 + 1) * sample_rate / fft_length

    def run(x: np.ndarray, pitch: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(bins)), upper_bound)
        for row in np.flatnonzero(pitch > f_min):
            a = np.log(np.clip(band_residuals(x[row], pitch[row], sample_rate, bands), lower_bound, upper_bound))
            out[row] = np.exp(np.interp(bins, centre, np.concatenate([a[:1], a, a[-1:]])))
        out = np.clip(out, lower_bound, upper_bound)
        return {"a": out, "p": 1 - out, "a/p": out / (1 - out), "p/a": (1 - out) / out}[out_format]

    size = 2 * (2 * int(np.ceil(sample_rate / f_min)) + 2)
    frames = seq.frame(samples, size, frame_period, True)
    return frames.join(f0.select("seq", "t", F.col("x").alias("f0")), ["seq", "t"]).select("seq", "t", batched(run, "x", "f0").alias("x"))


def minimum_phase(power: np.ndarray, fft_length: int) -> np.ndarray:
    """Spectra of minimum phase with the given powers."""
    c = np.fft.irfft(0.5 * np.log(np.maximum(power, 1e-16)), fft_length)
    c[:, 1 : fft_length // 2] *= 2
    c[:, fft_length // 2 + 1 :] = 0
    return np.exp(np.fft.rfft(c, fft_length))


def world_synth(f0: DataFrame, aperiodicity: DataFrame, spectrum: DataFrame, frame_period: int, sample_rate: float, fft_length: int, default_f0: float = 500.0, seed: int = 0) -> DataFrame:
    """(seq, n, x) from pitch (Hz, 0 where unvoiced), aperiodicity and power spectrum, each (seq, t, x).

    The phase is a running sum of the pitch; a pulse stands where it passes a whole turn. Every pulse becomes a row with
    the response of its moment, and responses are added by sample. Noise is a function of seed, place and sequence.
    """
    track = f0.select("seq", F.col("t").alias("n"), F.when(F.col("x") > 0, F.col("x")).otherwise(default_f0).alias("x"))
    voiced = f0.select("seq", F.col("t").alias("n"), F.when(F.col("x") > 0, 1.0).otherwise(0.0).alias("x"))
    rate = seq.linear_intpl(track, frame_period).withColumnRenamed("x", "f0")
    rows = rate.join(seq.linear_intpl(voiced, frame_period).withColumnRenamed("x", "voiced"), ["seq", "n"])
    turns = seq.running_sum(rows, F.col("f0") / sample_rate, "turns")
    pulses = turns.filter(F.floor("turns") > F.floor(F.col("turns") - F.col("f0") / sample_rate)).select("seq", "n", "f0", (F.col("voiced") > 0.5).cast("double").alias("voiced"))
    placed = pulses.withColumn("t", F.floor(F.col("n") / F.lit(frame_period)).cast("long")).withColumn("share", (F.col("n") % frame_period) / F.lit(float(frame_period)))
    for name, frames in (("a", aperiodicity), ("s", spectrum)):
        after = frames.select("seq", (F.col("t") - 1).alias("t"), F.col("x").alias(f"{name}_after"))
        placed = placed.join(frames.select("seq", "t", F.col("x").alias(name)), ["seq", "t"]).join(after, ["seq", "t"], "left").withColumn(f"{name}_after", F.coalesce(f"{name}_after", name))

    def run(a, a_after, s, s_after, share, pitch, is_voiced, draw):
        a = a + (a_after - a) * share[:, None]
        s = s + (s_after - s) * share[:, None]
        a = np.where(is_voiced[:, None] > 0, np.clip(a, 0, 1) ** 2, 1.0)
        size = np.maximum(np.round(sample_rate / pitch), 1).astype(int)
        noise = np.zeros((len(s), fft_length))
        for row, (count, k) in enumerate(zip(size, draw, strict=True)):
            values = np.random.default_rng(int(k)).normal(size=min(count, fft_length))
            noise[row, : len(values)] = values - values.mean()
        pulse = np.fft.irfft(minimum_phase(s * (1 - a), fft_length), fft_length) * (is_voiced * np.sqrt(size))[:, None]
        return pulse + np.fft.irfft(minimum_phase(s * a, fft_length) * np.fft.rfft(noise), fft_length)

    drawn = F.pmod(F.xxhash64(F.lit(seed), "seq", "n"), F.lit(1 << 31)).cast("double")
    response = batched(run, "a", "a_after", "s", "s_after", "share", "f0", "voiced", drawn)
    added = placed.select("seq", "n", F.posexplode(response).alias("j", "x")).select("seq", (F.col("n") + F.col("j")).alias("n"), "x").groupBy("seq", "n").agg(F.sum("x").alias("x"))
    ends = f0.groupBy("seq").agg(((F.max("t") + 1) * frame_period).alias("end"))
    return added.join(ends, "seq").filter("n < end").select("seq", "n", "x")
