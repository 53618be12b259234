"""Aperiodicity from the group delay of frames, band by band.

In a periodic sound the group delay, averaged over one period, does not depend on
where in the period a frame stands: two frames half a period apart give it free of
the moment. Smoothed and freed of its slow part it is a sine over frequency, with
the pitch for its period; what is no sine is noise. In each band of 3 kHz the
transform of this delay is sorted by power, and the share that lies outside the
few strongest places is the aperiodic one.

Frames come from sequences.frame and meet their pitch by (seq, t); all frames of an
Arrow batch are worked on together, a bounded number at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, require
from . import sequences as seq

#: Distance of bands and highest band (Hz), pitch below which a frame is unvoiced, and pitch that sets the transform's length.
BAND, HIGHEST, LOWEST_PITCH, LENGTH_PITCH = 3000, 15000, 40, 47
#: Bands of the voicing measure (Hz), and level at 0 Hz (dB).
VOICING, FLOOR = (100, 4000, 7900), -60.0


def transform_length(sample_rate: float, periods: int, pitch: float) -> int:
    """Power of two that holds so many periods of a pitch."""
    return 2 ** (1 + int(np.log2(periods * sample_rate / pitch + 1)))


def parts(x: np.ndarray, f0: np.ndarray, sample_rate: float, periods: int, late: float, window: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windowed frames, late periods behind the middle, of so many periods each, as rows of size places from the window's first one, free of their mean; and which places are the window's."""
    middle = x.shape[1] // 2
    half = np.floor(periods / 2 * sample_rate / f0 + 0.5).astype(int)
    origin = middle + np.floor(late * sample_rate / f0 + 0.5).astype(int)
    n = np.arange(size)[None] - half[:, None]
    inside = n <= half[:, None]
    turn = np.pi * n * f0[:, None] / (periods / 2 * sample_rate)
    w = np.where(inside, 0.42 + 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn) if window == "blackman" else 0.5 + 0.5 * np.cos(turn), 0.0)
    y = np.take_along_axis(x, np.clip(origin[:, None] + n, 0, x.shape[1] - 1), 1) * w
    return y - w * (y.sum(axis=1) / w.sum(axis=1))[:, None], inside


def between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of values at fractional places, along lines; at the edges as far as the rows go."""
    low = np.clip(np.floor(at).astype(int), 0, values.shape[1] - 2)
    share = np.clip(at - low, 0, 1)
    first = np.take_along_axis(values, low, 1)
    return first + share * (np.take_along_axis(values, low + 1, 1) - first)


def folded(spectrum: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """Spectra with what lies between 0 and the pitch (in bins) added to its mirror image there: a windowed sound has no harmonic at 0."""
    bins = np.arange(spectrum.shape[1])[None]
    return spectrum + np.where(bins < pitch[:, None], between(spectrum, np.maximum(pitch[:, None] - bins, 0)), 0)


def box_means(spectrum: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Means over a width (in bins) around each bin, of spectra mirrored at both ends."""
    count = spectrum.shape[1]
    reach = int(np.ceil(width.max() / 2)) + 2
    mirrored = np.abs(np.arange(-reach, count + reach))
    mirrored = np.where(mirrored >= count, 2 * (count - 1) - mirrored, mirrored)
    area = np.cumsum(spectrum[:, np.clip(mirrored, 0, count - 1)], axis=1)  # up to half a bin behind each place
    at = np.arange(count)[None] + reach - 0.5
    half = width[:, None] / 2
    return (between(area, at + half) - between(area, at - half)) / width[:, None]


def centroid(x: np.ndarray, f0: np.ndarray, sample_rate: float, late: float, size: int) -> np.ndarray:
    """Spectra of power times delay."""
    y, inside = parts(x, f0, sample_rate, 4, late, "blackman", size)
    y = y / np.sqrt(np.maximum((y * y).sum(axis=1), 1e-300))[:, None]
    return (np.fft.rfft(y) * np.fft.rfft(y * np.where(inside, np.arange(1, size + 1), 0)).conj()).real


def band_levels(x: np.ndarray, f0: np.ndarray, sample_rate: float, size: int) -> np.ndarray:
    """Aperiodic share of each band in dB, from frames (rows, places) and their pitch."""
    pitch = f0 * size / sample_rate
    both = folded(centroid(x, f0, sample_rate, -0.25, size) + centroid(x, f0, sample_rate, 0.25, size), pitch)
    y, _ = parts(x, f0, sample_rate, 4, 0, "hanning", size)
    power = box_means(folded(np.abs(np.fft.rfft(y)) ** 2, pitch), pitch)
    delay = box_means(both / (power + 1e-12), pitch / 2)
    delay = delay - box_means(delay, pitch)
    bands = int(min(HIGHEST, sample_rate / 2 - BAND) / BAND)
    window = bases.window_values(BAND * size // int(sample_rate) * 2 + 1, "nuttall")
    reach, held = len(window) // 2, round(size * 8 / len(window))
    out = np.empty((len(x), bands))
    for k in range(bands):
        middle = BAND * (k + 1) * size // int(sample_rate)
        sorted_ = np.sort(np.abs(np.fft.rfft(delay[:, middle - reach : middle + reach + 1] * window, size)) ** 2, axis=1)
        weak = sorted_[:, : -(held + 1)].sum(axis=1)
        out[:, k] = 10 * np.log10(np.maximum(weak, 1e-300) / np.maximum(sorted_.sum(axis=1), 1e-300))
    return np.minimum(out + (f0[:, None] - 100) / 50, 0.0)


def voiced_share(x: np.ndarray, f0: np.ndarray, sample_rate: float) -> np.ndarray:
    """Share of the power below 4 kHz in that below 7.9 kHz: small in frames without voice."""
    size = transform_length(sample_rate, 3, LOWEST_PITCH)
    y, _ = parts(x, f0, sample_rate, 3, 0, "blackman", size)
    power = np.abs(np.fft.rfft(y)) ** 2
    low, high, top = (int(np.ceil(f * size / sample_rate)) for f in VOICING)
    return power[:, low + 1 : high + 1].sum(axis=1) / np.maximum(power[:, low + 1 : top + 1].sum(axis=1), 1e-300)


def ap_group_delay(samples: DataFrame, f0: DataFrame, frame_period: int, sample_rate: float, fft_length: int | None = None, threshold: float = 0.0, default_f0: float = 150.0) -> DataFrame:
    """(seq, t, x): aperiodicity (a share of amplitude, 0 to 1) at every bin of fft_length, or in dB of bands 3 kHz apart without one. f0: (seq, t, x) in Hz.

    An unvoiced frame (below 40 Hz, or null) is measured with default_f0. With a threshold, frames whose power lies above 4 kHz
    count as aperiodic throughout. Frames of silence are aperiodic.
    """
    require(the_sample_rate_is_12000_at_least=sample_rate >= 12000, the_threshold_is_not_negative=threshold >= 0, default_f0_is_above_0=default_f0 > 0)
    size = transform_length(sample_rate, 4, LENGTH_PITCH)
    coarse = np.append(np.arange(int(min(HIGHEST, sample_rate / 2 - BAND) / BAND) + 1) * float(BAND), sample_rate / 2)

    def run(x: np.ndarray, pitch: np.ndarray) -> np.ndarray:
        pitch = np.where(pitch >= LOWEST_PITCH, pitch, default_f0)
        out = []
        for at in range(0, len(x), 64):  # bounds the memory
            own, f = x[at : at + 64], pitch[at : at + 64]
            levels = band_levels(own, f, sample_rate, size)
            levels[~own.any(axis=1)] = 0.0
            if fft_length is None:
                out.append(levels)
                continue
            full = np.column_stack([np.full(len(own), FLOOR), levels, np.zeros(len(own))])
            bins = np.arange(fft_length // 2 + 1) * sample_rate / fft_length
            share = 10 ** (np.stack([np.interp(bins, coarse, row) for row in full]) / 20)
            if threshold > 0:
                share[voiced_share(own, f, sample_rate) <= threshold] = 1.0
            out.append(share)
        return np.concatenate(out) if out else np.zeros((0, 1))

    reach = int(np.ceil(2.25 * sample_rate / LOWEST_PITCH)) + 2
    frames = seq.frame(samples, 2 * reach + 1, frame_period, True)
    return frames.join(f0.select("seq", "t", F.coalesce("x", F.lit(0.0)).alias("f0")), ["seq", "t"]).select("seq", "t", batched(run, "x", "f0").alias("x"))
