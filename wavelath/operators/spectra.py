"""Spectra, filter banks and the features made of them.

Vector functions take one frame or spectrum as a row. Sequence functions (stft,
istft, mdct and the filter banks) are made of framing and scatter from
sequences.py, so that no sequence is gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, col, linear, require
from ..functions.scales import hz_to_scale, scale_to_hz
from . import blocks
from . import sequences as seq
from .prediction import convert_cepstrum, pick, predictors
from .transforms import fit_length

OUT = ("db", "log-magnitude", "magnitude", "power")


def without_gain(a: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(a)), a[:, 1:]])


def spec(b: Column | str | None = None, a: Column | str | None = None, fft_length: int = 512, eps: float = 0, relative_floor: float | None = None, out_format: str | int = "power") -> Column:
    """Spectrum of b, of gain / a, or of gain * b / a. relative_floor is in dB below the frame's largest bin."""
    require(b_or_a_is_needed=b is not None or a is not None)
    kind, above, below = pick(OUT, out_format), b is not None, a is not None

    def run(*given: np.ndarray) -> np.ndarray:
        x = np.abs(np.fft.rfft(given[0], fft_length)) if above else np.ones(1)
        if below:
            poly = given[-1]
            x = poly[:, :1] * x / np.abs(np.fft.rfft(without_gain(poly), fft_length))
        s = x**2 + eps
        if relative_floor is not None:
            s = np.maximum(s, s.max(axis=1, keepdims=True) * 10 ** (relative_floor / 10))
        with np.errstate(divide="ignore"):
            return {"db": lambda: 10 * np.log10(s), "log-magnitude": lambda: 0.5 * np.log(s), "magnitude": lambda: np.sqrt(s), "power": lambda: s}[kind]()

    return batched(run, *[c for c in (b, a) if c is not None])


def windowed(frame_length: int, fft_length: int, window, norm, symmetric):
    values = bases.window_values(frame_length, window, norm, symmetric)
    return lambda v: fit_length(v * values, fft_length)


def stft(
    samples: DataFrame, frame_length: int, frame_period: int, fft_length: int, center: bool = True, zmean: bool = False, mode: str = "constant", window: str | int = "blackman",
    norm: str | int = "power", symmetric: bool = True, eps: float = 1e-9, relative_floor: float | None = None, out_format: str = "power",
) -> DataFrame:
    """(seq, t, x) or, for complex, (seq, t, re, im): framing, window and spectrum, the last two in one step."""
    frames = seq.frame(samples, frame_length, frame_period, center, zmean, mode)
    shape = windowed(frame_length, fft_length, window, norm, symmetric)
    if out_format == "complex":
        part = lambda get: batched(lambda v: get(np.fft.rfft(shape(v))), "x")
        return frames.select("seq", "t", part(np.real).alias("re"), part(np.imag).alias("im"))
    weighted = batched(shape, "x")
    return frames.select("seq", "t", spec(weighted, None, fft_length, eps, relative_floor, out_format).alias("x"))


def istft(spectra: DataFrame, frame_length: int, frame_period: int, fft_length: int, center: bool = True, window: str | int = "blackman", norm: str | int = "power", symmetric: bool = True, out_length: int | None = None) -> DataFrame:
    """(seq, n, x) of complex spectra (seq, t, re, im)."""
    frames = spectra.select("seq", "t", batched(lambda a, b: np.fft.irfft(a + 1j * b, fft_length)[:, :frame_length], "re", "im").alias("x"))
    return seq.unframe(frames, frame_length, frame_period, center, window, norm, symmetric, out_length)


def mdct(samples: DataFrame, frame_length: int, window: str | int = "sine", sine: bool = False) -> DataFrame:
    """(seq, t, x): lapped transform of frames that overlap by half; one frame more than there are whole halves."""
    half = frame_length // 2
    sizes = seq.lengths(samples)
    # half a frame of zeros after the end opens one more frame
    more = sizes.select("seq", F.explode(seq.steps(F.col("length"), F.col("length") + half - 1)).alias("n"), F.lit(0.0).alias("x"))
    frames = seq.frame(samples.select("seq", "n", "x").unionByName(more), frame_length, half, True)
    basis = bases.lapped_matrix(frame_length, window, sine)
    return frames.select("seq", "t", linear(basis)("x").alias("x"))


def imdct(bins: DataFrame, frame_length: int, window: str | int = "sine", sine: bool = False, out_length: int | None = None) -> DataFrame:
    half = frame_length // 2
    basis = bases.lapped_matrix(frame_length, window, sine).T / 2
    frames = bins.select("seq", "t", linear(basis)("x").alias("x"))
    sent = frames.select("seq", "t", F.posexplode("x").alias("j", "v")).select("seq", (F.col("t") * half + F.col("j") - half).alias("n"), "v").filter("n >= 0")
    added = sent.groupBy("seq", "n").agg(F.sum("v").alias("x"))
    if out_length is not None:
        return added.filter(F.col("n") < out_length)
    ends = bins.groupBy("seq").agg((F.max("t") * half).alias("end"))
    return blocks.joined(added, ends, ["seq"]).filter("n < end").select("seq", "n", "x")


def mdst(samples: DataFrame, frame_length: int, window: str | int = "sine") -> DataFrame:
    return mdct(samples, frame_length, window, sine=True)


def imdst(bins: DataFrame, frame_length: int, window: str | int = "sine", out_length: int | None = None) -> DataFrame:
    return imdct(bins, frame_length, window, True, out_length)


# --- filter banks on the frequency axis


def triangles(fft_length: int, n_channel: int, sample_rate: float, f_min: float = 0, f_max: float | None = None, scale: str = "htk") -> np.ndarray:
    """Weights (bins, channels): triangles between neighbouring centres on a scale."""
    f_max = sample_rate / 2 if f_max is None else f_max
    low, high = (float(hz_to_scale(f, scale)) for f in (f_min, f_max))
    edges = low + (high - low) * np.arange(n_channel + 2) / (n_channel + 1)
    out = np.zeros((fft_length // 2 + 1, n_channel))
    bins = np.arange(max(1, int(f_min / sample_rate * fft_length + 1.5)), min(fft_length // 2, int(f_max / sample_rate * fft_length + 0.5)))
    place = hz_to_scale(sample_rate * bins / fft_length, scale)
    for m in range(n_channel):
        rise = (place - edges[m]) / (edges[m + 1] - edges[m])
        fall = (edges[m + 2] - place) / (edges[m + 2] - edges[m + 1])
        out[bins, m] = np.maximum(np.minimum(rise, fall), 0)
    return out


#: The equivalent rectangular bandwidth of the ear as a polynomial of the frequency in Hz, highest power first.
ERB_POLYNOMIAL = (6.23e-6, 93.39e-3, 28.52)


def erb_filters(fft_length: int, n_channel: int, sample_rate: float, f_min: float, f_max: float | None, scale: str, factor: float) -> np.ndarray:
    """Weights (bins, channels): triangles as wide as factor bandwidths to both sides, symmetric on the mel axis of 700 Hz.

    On that axis (700 + low)(700 + high) = (700 + centre)^2, and high - low is twice the bandwidth at the centre. The first
    triangle begins at f_min and the last one ends at f_max; centres between them are evenly spaced on the scale.
    """
    width = np.poly1d(factor * np.array(ERB_POLYNOMIAL))
    square = np.poly1d([1.0, 700.0]) ** 2

    def centre_of(edge: float, side: int) -> float:
        """The centre whose triangle has its lower (side 1) or upper (side -1) end at edge."""
        return float(np.max((square - (700 + edge) * (700 + edge + 2 * side * width)).roots.real))

    ends = hz_to_scale([centre_of(f_min, 1), centre_of(sample_rate / 2 if f_max is None else f_max, -1)], scale)
    centre = scale_to_hz(np.linspace(*ends, n_channel), scale)
    half = width(centre)
    low = np.hypot(half, 700 + centre) - 700 - half
    corners = np.stack([low, centre, low + 2 * half])
    f = np.linspace(0, sample_rate / 2, fft_length // 2 + 1)
    return np.stack([np.interp(f, c, [0.0, 1.0, 0.0], left=0, right=0) for c in corners.T], axis=1)


def bank(fft_length, n_channel, sample_rate, f_min=0, f_max=None, scale="htk", erb_factor=None) -> np.ndarray:
    if erb_factor is None:
        return triangles(fft_length, n_channel, sample_rate, f_min, f_max, scale)
    return erb_filters(fft_length, n_channel, sample_rate, f_min, f_max, scale, erb_factor)


def log_energy(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log((2 * x[:, 1:-1].sum(1) + x[:, 0] + x[:, -1]) / (2 * (x.shape[1] - 1)))[:, None]


def channels(x: np.ndarray, weights: np.ndarray, floor: float, gamma: float, use_power: bool) -> np.ndarray:
    y = np.maximum((x if use_power else np.sqrt(x)) @ weights, floor)
    return np.log(y) if gamma == 0 else (y**gamma - 1) / gamma


def fbank(
    x: Column | str, fft_length: int, n_channel: int, sample_rate: float, f_min: float = 0, f_max: float | None = None, floor: float = 1e-5, gamma: float = 0, scale: str = "htk",
    erb_factor: float | None = None, use_power: bool = False, out_format: str | int = "y",
) -> Column:
    """Filter bank of a power spectrum: y, or y and the energy behind it (yE)."""
    weights = bank(fft_length, n_channel, sample_rate, f_min, f_max, scale, erb_factor)
    kind = pick(("y", "yE"), out_format)

    def run(v: np.ndarray) -> np.ndarray:
        y = channels(v, weights, floor, gamma, use_power)
        return y if kind == "y" else np.column_stack([y, log_energy(v)])

    return batched(run, x)


def ifbank(y: Column | str, n_channel: int, fft_length: int, sample_rate: float, f_min: float = 0, f_max: float | None = None, gamma: float = 0, scale: str = "htk", erb_factor: float | None = None, use_power: bool = False) -> Column:
    """The power spectrum of least norm with the given filter bank outputs."""
    back = np.linalg.pinv(bank(fft_length, n_channel, sample_rate, f_min, f_max, scale, erb_factor))

    def run(v: np.ndarray) -> np.ndarray:
        s = (np.exp(v) if gamma == 0 else (gamma * v + 1) ** (1 / gamma)) @ back
        return s if use_power else s**2

    return batched(run, y)


CEPSTRUM_PARTS = ("y", "yE", "yc", "ycE")


def parts(kind: str, y: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
    return np.column_stack([{"y": y, "c": c, "E": e}[k] for k in kind])


def lifter_values(order: int, lifter: int, first: float) -> np.ndarray:
    out = 1 + lifter / 2 * np.sin(np.pi / lifter * np.arange(order + 1))
    out[0] = first
    return out


def mfcc(
    x: Column | str, fft_length: int, mfcc_order: int, n_channel: int, sample_rate: float, lifter: int = 1, f_min: float = 0, f_max: float | None = None, floor: float = 1e-5,
    gamma: float = 0, scale: str = "htk", erb_factor: float | None = None, out_format: str | int = "y",
) -> Column:
    """Mel-frequency cepstral coefficients of a power spectrum; c is the zeroth, E the energy."""
    weights = bank(fft_length, n_channel, sample_rate, f_min, f_max, scale, erb_factor)
    basis = bases.dct_matrix(n_channel)[: mfcc_order + 1] * lifter_values(mfcc_order, lifter, np.sqrt(2))[:, None]
    kind = pick(CEPSTRUM_PARTS, out_format)

    def run(v: np.ndarray) -> np.ndarray:
        c = channels(v, weights, floor, gamma, False) @ basis.T
        return parts(kind, c[:, 1:], c[:, :1], log_energy(v))

    return batched(run, x)


def plp(
    x: Column | str, fft_length: int, plp_order: int, n_channel: int, sample_rate: float, compression_factor: float = 0.33, lifter: int = 1, f_min: float = 0, f_max: float | None = None,
    floor: float = 1e-5, gamma: float = 0, scale: str = "htk", erb_factor: float | None = None, n_fft: int = 512, out_format: str | int = "y",
) -> Column:
    """Perceptual linear prediction of a power spectrum."""
    weights = bank(fft_length, n_channel, sample_rate, f_min, f_max, scale, erb_factor)
    top = sample_rate / 2 if f_max is None else f_max
    low, high = (float(hz_to_scale(f, scale)) for f in (f_min, top))
    square = scale_to_hz(low + (high - low) * np.arange(1, n_channel + 1) / (n_channel + 1), scale) ** 2
    loudness = (square / (square + 1.6e5)) ** 2 * (square + 1.44e6) / (square + 9.61e6)
    lift, kind = lifter_values(plp_order, lifter, 2.0), pick(CEPSTRUM_PARTS, out_format)

    def run(v: np.ndarray) -> np.ndarray:
        y = (np.exp(channels(v, weights, floor, gamma, True)) * loudness) ** compression_factor
        y = np.column_stack([y[:, :1], y, y[:, -1:]])
        size = 2 * (y.shape[1] - 1)
        a = predictors(np.fft.hfft(y, size)[:, : plp_order + 1] / size, 0.0)
        # in normalised and multiplied form, a predictor is a model of gamma -1
        c = convert_cepstrum(a, plp_order, -1.0, 0.0, 0.0, True, False, True, False, n_fft) * lift
        return parts(kind, c[:, 1:], c[:, :1], log_energy(v))

    return batched(run, x)


def chroma_weights(fft_length: int, n_channel: int, sample_rate: float) -> np.ndarray:
    """Weights (channels, bins): Gaussian bumps around each pitch class, stronger toward the fifth octave."""
    f = np.arange(1, fft_length) * sample_rate / fft_length
    place = n_channel * np.log2(f / 27.5)
    place = np.concatenate([[place[0] - 1.5 * n_channel], place])
    width = np.concatenate([np.maximum(np.diff(place), 1.0), [1.0]])
    gap = place - np.arange(n_channel)[:, None]
    gap = np.remainder(gap + round(n_channel / 2) + 10 * n_channel, n_channel) - round(n_channel / 2)
    w = np.exp(-0.5 * (2 * gap / width) ** 2)
    w /= np.sqrt(np.sum(w**2, axis=0))
    w *= np.exp(-0.5 * ((place / n_channel - 5) / 2) ** 2)
    return np.roll(w, -3 * (n_channel // 12), axis=0)[:, : fft_length // 2 + 1]


def chroma(x: Column | str, fft_length: int, n_channel: int, sample_rate: float, norm: float = float("inf"), use_power: bool = True) -> Column:
    """Energy by pitch class, normalised."""
    w = chroma_weights(fft_length, n_channel, sample_rate)

    def run(v: np.ndarray) -> np.ndarray:
        y = (v if use_power else np.sqrt(v)) @ w.T
        size = np.linalg.norm(y, norm, axis=1, keepdims=True)
        return y / np.where(size > 0, size, 1)

    return batched(run, x)


# --- phase


def polynomials(b, a):
    """Which of numerator and denominator are given, for functions of b, 1 / a or b / a."""
    require(b_or_a_is_needed=b is not None or a is not None)
    return [c for c in (b, a) if c is not None]


def grpdelay(b: Column | str | None = None, a: Column | str | None = None, fft_length: int = 512, alpha: float = 1, gamma: float = 1) -> Column:
    """Group delay: that of b plus that of a reversed denominator, less its order."""

    above, below = b is not None, a is not None

    def run(*given: np.ndarray) -> np.ndarray:
        order = 0
        c = given[0] if above else np.ones((len(given[0]), 1))
        if below:
            back = without_gain(given[-1])[:, ::-1]
            order = back.shape[1] - 1
            whole = np.zeros((len(c), c.shape[1] + order))
            for k in range(order + 1):
                whole[:, k : k + c.shape[1]] += c * back[:, k : k + 1]
            c = whole
        spectrum, ramped = np.fft.rfft(c, fft_length), np.fft.rfft(c * np.arange(c.shape[1]), fft_length)
        g = (spectrum * ramped.conj()).real / np.abs(spectrum) ** (2 * gamma) - order
        return np.sign(g) * np.abs(g) ** alpha

    return batched(run, *polynomials(b, a))


def phase(b: Column | str | None = None, a: Column | str | None = None, fft_length: int = 512, unwrap: bool = False) -> Column:
    """Phase in units of pi; unwrap adds 2 wherever a step is larger than 1."""

    above, below = b is not None, a is not None

    def run(*given: np.ndarray) -> np.ndarray:
        x = np.fft.rfft(given[0], fft_length) if above else np.ones(1)
        if below:
            x = x * np.fft.rfft(without_gain(given[-1]), fft_length).conj()
        p = np.arctan2(x.imag, x.real) / np.pi
        if unwrap:
            jump = np.diff(p, axis=1)
            p[:, 1:] += 2 * np.cumsum((jump < -1).astype(int) - (jump > 1), axis=1)
        return p

    return batched(run, *polynomials(b, a))


def yingram(x: Column | str, sample_rate: float = 22050, lag_min: int = 22, lag_max: int | None = None, n_bin: int = 20) -> Column:
    """Cumulative-mean normalised differences at lags spaced by n_bin to a semitone (A4 is 440 Hz), from the longest on."""
    semitone = lambda lag: 69 + 12 * np.log2(sample_rate / 440 / lag)

    def run(v: np.ndarray) -> np.ndarray:
        count = v.shape[1] - 1 if lag_max is None else lag_max
        notes = np.arange(int(np.ceil(semitone(count))), int(semitone(lag_min)) + 1, 1 / n_bin)
        lags = sample_rate / 440 * 2 ** ((69 - notes) / 12)
        difference = np.stack([np.square(v[:, : -k or None] - v[:, k:]).sum(1) for k in range(1, count)], axis=1)
        mean = np.cumsum(difference, axis=1) / np.arange(1, count)
        normal = np.column_stack([np.ones(len(v)), difference / (mean + 1e-7 / np.arange(1, count))])
        # a value between whole lags is on the line between them: hats around each lag
        hats = np.maximum(1 - np.abs(np.arange(count)[:, None] - lags), 0)
        return normal @ hats

    return batched(run, x)


# --- filter banks in time


def pqmf_filters(n_band: int, filter_order: int, alpha: float = 100, synthesis: bool = False) -> np.ndarray:
    """Cosine-modulated copies of a Kaiser prototype whose gain at the band edge is 3 dB down."""
    beta = 0 if alpha <= 21 else 0.5842 * (alpha - 21) ** 0.4 + 0.07886 * (alpha - 21) if alpha <= 50 else 0.1102 * (alpha - 8.7)
    x = np.arange(filter_order + 1) - 0.5 * filter_order
    kaiser = np.kaiser(filter_order + 1, beta)
    size = 1 << filter_order.bit_length() if filter_order + 1 > 1 << (filter_order.bit_length() - 1) else filter_order + 1
    edge = size // (4 * n_band)

    def prototype(omega: float) -> np.ndarray:
        return omega / np.pi * np.sinc(omega * x / np.pi) * kaiser

    low, high = 0.0, np.pi / n_band
    for _ in range(100):  # the gain at the edge rises with the cutoff: halving finds it
        middle = 0.5 * (low + high)
        gain = np.abs(np.exp(-2j * np.pi * edge / size * np.arange(filter_order + 1)) @ prototype(middle)) ** 2
        low, high = (low, middle) if gain > 0.5 else (middle, high)
    p = prototype(0.5 * (low + high))
    k = np.arange(n_band)[:, None]
    return 2 * p * np.cos((2 * k + 1) * np.pi / (2 * n_band) * x + (-1.0) ** k * np.pi / 4 * (-1 if synthesis else 1))


def pqmf(samples: DataFrame, n_band: int, filter_order: int, alpha: float = 100) -> DataFrame:
    """(seq, n, x vector of bands)."""
    taps = pqmf_filters(n_band, filter_order, alpha)
    left = (filter_order + 1) // 2
    return seq.fir(samples, taps, left, hold_end=filter_order - left)


def ipqmf(bands: DataFrame, n_band: int, filter_order: int, alpha: float = 100) -> DataFrame:
    """(seq, n, x) of bands (seq, n, x vector): all bands in one shuffle."""
    taps = pqmf_filters(n_band, filter_order, alpha, synthesis=True)
    left = filter_order // 2
    ahead = filter_order - left
    size = max(blocks.SIZE // n_band, filter_order)
    n, last = F.col("n"), F.floor((F.col("length") - 1) / F.lit(size))
    low, high = F.greatest(F.floor((n - ahead) / F.lit(size)), F.lit(0)), F.least(F.floor((n + left) / F.lit(size)), last)
    sent = blocks.joined(bands, seq.lengths(bands), ["seq"]).select("seq", F.explode(F.sequence(low, high)).alias("block"), n.cast("long").alias("n"), "length", F.col("x").cast("array<double>").alias("v"))

    def run(block: blocks.Block):
        total = left + block.count + ahead
        x = np.zeros((total, n_band))
        at = block.numbers - (block.begin - left)
        own = (at >= 0) & (at < total)
        x[at[own]] = block.vectors[own]
        end = block.length - (block.begin - left)
        if 0 < end < total:
            x[end:] = x[end - 1]
        y = sum(blocks.convolved(x[:, k], taps[k : k + 1])[:, 0] for k in range(n_band))
        return np.arange(block.begin, block.begin + block.count), y

    return blocks.work(sent, run, size)


def octave_filters(sample_rate: float, f_min: float = 40, f_ref: float = 1000, f_max: float = 8000, filter_order: int = 1000, n_fract: int = 1, overlap: float = 1) -> np.ndarray:
    """Linear-phase filters of fractional octave bands, in steps of 10^0.3 / n_fract around f_ref.

    The gain of a band over all bins is its rise at its lower edge times what the next band leaves there; a rise is a squared
    sine as wide as overlap says. So neighbours add up to one.
    """
    octave = 0.3 / n_fract
    offset = 0.5 * (n_fract % 2 == 0)
    first, last = (int(np.round(np.log10(f / f_ref) / octave - offset)) for f in (f_min, f_max))
    centre = f_ref * 10 ** (octave * (np.arange(first, last + 1) + offset))
    centre = centre[centre < sample_rate / 2]
    size = filter_order + 1
    bins = np.arange(size // 2 + 1)
    low, middle, high = np.round(size / sample_rate * centre * 10 ** (octave * np.array([[-0.5], [0.0], [0.5]])))
    reach = np.round((high - middle) * overlap / 2)[:, None]
    rise = np.where(bins >= low[:, None] + reach, 1.0, np.clip((bins - low[:, None] + reach) / np.maximum(2 * reach, 1), 0, 1))
    rise = np.sin(np.pi / 2 * rise) ** 2
    rise[0] = 1  # the lowest band reaches down to 0 Hz, the highest up to the end
    gain = rise * np.vstack([1 - rise[1:], np.ones(len(bins))])
    # the response is a sum of cosines, delayed by half the order on the axis of the bins; an even number of taps
    taps = 2 * (len(bins) - 1)
    once = np.where((bins == 0) | (2 * bins == taps), 1.0, 2.0) / taps
    waves = np.cos(2 * np.pi * np.outer(bins, np.arange(taps) / taps - 0.5 * filter_order / size))
    return (gain * once) @ waves * np.hanning(taps)


def oband(samples: DataFrame, sample_rate: float, f_min: float = 40, f_ref: float = 1000, f_max: float = 8000, filter_order: int = 1000, n_fract: int = 1, overlap: float = 1) -> DataFrame:
    """(seq, n, x vector of bands)."""
    taps = octave_filters(sample_rate, f_min, f_ref, f_max, filter_order, n_fract, overlap)
    left = (filter_order + 1) // 2
    return seq.fir(samples, taps[:, ::-1], left, hold_end=taps.shape[1] - 1 - left)


def scalar(x: Column | str) -> Column:
    return F.get(col(x), F.lit(0))
