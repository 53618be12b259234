"""Transforms by constant matrices: one matrix product for each Arrow batch of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, col, linear, numbers, require, whole, zeros


def dct(x: Column | str, dct_length: int, dct_type: int = 2) -> Column:
    return linear(bases.dct_matrix(dct_length, dct_type))(x)


def idct(y: Column | str, dct_length: int, dct_type: int = 2) -> Column:
    return dct(y, dct_length, bases.INVERSE[dct_type])


def dst(x: Column | str, dst_length: int, dst_type: int = 2) -> Column:
    return linear(bases.dst_matrix(dst_length, dst_type))(x)


def idst(y: Column | str, dst_length: int, dst_type: int = 2) -> Column:
    return dst(y, dst_length, bases.INVERSE[dst_type])


def dht(x: Column | str, dht_length: int, dht_type: int = 2) -> Column:
    return linear(bases.dht_matrix(dht_length, dht_type))(x)


def idht(y: Column | str, dht_length: int, dht_type: int = 2) -> Column:
    return dht(y, dht_length, bases.INVERSE[dht_type])


def wht(x: Column | str, wht_length: int, wht_type: str | int = "natural") -> Column:
    """Walsh-Hadamard transform; its own inverse."""
    return linear(bases.wht_matrix(wht_length, wht_type))(x)


iwht = wht


def window(x: Column | str, in_length: int, out_length: int | None = None, window: str | int = "blackman", norm: str | int = "power", symmetric: bool = True) -> Column:
    """x times a window, padded on the right to out_length."""
    y = F.zip_with(col(x), numbers(bases.window_values(in_length, window, norm, symmetric)), lambda a, w: a * w)
    return y if out_length is None or out_length == in_length else F.concat(y, zeros(out_length - in_length))


def fit_length(x: np.ndarray, length: int) -> np.ndarray:
    """Rows cut or padded with zeros to a length."""
    return x[:, :length] if x.shape[1] >= length else np.pad(x, ((0, 0), (0, length - x.shape[1])))


SPECTRUM_PARTS = {"real": np.real, "imaginary": np.imag, "amplitude": np.abs, "power": lambda s: s.real**2 + s.imag**2}


def fftr(x: Column | str, fft_length: int, out_format: str | int = "complex") -> Column:
    """Spectrum of real vectors, fft_length / 2 + 1 bins; complex is a struct of re and im."""
    out_format = ("complex", *SPECTRUM_PARTS)[out_format] if isinstance(out_format, int) else out_format
    if out_format == "complex":
        part = lambda name: fftr(x, fft_length, name)
        return F.struct(part("real").alias("re"), part("imaginary").alias("im"))
    require(unknown_out_format=out_format in SPECTRUM_PARTS, fft_length_is_even=fft_length % 2 == 0)
    return batched(lambda v: SPECTRUM_PARTS[out_format](np.fft.rfft(fit_length(v, fft_length))), x)


def ifftr(re: Column | str, im: Column | str, fft_length: int, out_length: int | None = None) -> Column:
    """Real vectors of half spectra."""
    return batched(lambda a, b: np.fft.irfft(a + 1j * b, fft_length)[:, : out_length or fft_length], re, im)


def hilbert(x: Column | str, fft_length: int | None = None) -> Column:
    """The analytic signal as a struct of re and im."""

    def analytic(v: np.ndarray) -> np.ndarray:
        n = fft_length or v.shape[1]
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        return np.fft.ifft(np.fft.fft(fit_length(v, n)) * gain)[:, : v.shape[1]]

    return F.struct(batched(lambda v: analytic(v).real, x).alias("re"), batched(lambda v: analytic(v).imag, x).alias("im"))


def freqt(c: Column | str, in_order: int, out_order: int, alpha: float = 0) -> Column:
    require(alpha_is_inside_the_unit_circle=abs(alpha) < 1)
    return linear(bases.freqt_matrix(in_order, out_order, alpha))(c)


def freqt2(c: Column | str, in_order: int, out_order: int, alpha: float = 0, theta: float = 0, n_fft: int = 512) -> Column:
    return linear(bases.freqt2_matrix(in_order, out_order, alpha, theta, n_fft))(c)


def ifreqt2(c: Column | str, in_order: int, out_order: int, alpha: float = 0, theta: float = 0, n_fft: int = 512) -> Column:
    return linear(bases.freqt2_matrix(in_order, out_order, alpha, theta, n_fft, inverse=True))(c)


def mc2b_matrix(order: int, alpha: float) -> np.ndarray:
    n = np.arange(order + 1)
    gap = n - n[:, None]
    return np.where(gap >= 0, (-float(alpha)) ** np.maximum(gap, 0), 0.0)


def mc2b(mc: Column | str, cep_order: int, alpha: float = 0) -> Column:
    """Filter coefficients of a mel-cepstrum: each is what stays when alpha times the next is taken away."""
    return linear(mc2b_matrix(cep_order, alpha))(mc)


def ndps2c(n: Column | str, fft_length: int, cep_order: int) -> Column:
    """Cepstrum of a negative derivative of phase spectrum."""

    def run(x: np.ndarray) -> np.ndarray:
        half = fft_length // 2
        even = np.fft.hfft(x, fft_length)[:, : cep_order + 1]
        k = np.arange(cep_order + 1, dtype=float)
        scale = np.divide(1.0, k * half, out=np.zeros(len(k)), where=k > 0)
        scale[k == half] /= 2
        return even * scale

    return batched(run, n)


def c2ndps(c: Column | str, cep_order: int, fft_length: int) -> Column:
    def run(x: np.ndarray) -> np.ndarray:
        half = fft_length // 2
        k = np.arange(cep_order + 1) * 0.5
        k[np.arange(cep_order + 1) == half] *= 2
        return np.fft.hfft(fit_length(x * k, half + 1), fft_length)[:, : half + 1]

    return batched(run, c)


def mlpg_matrix(size: int, seed=((-0.5, 0, 0.5), (1, -2, 1))) -> np.ndarray:
    """Least squares from size frames of static and dynamic features to the static track, unit variances."""
    rows = bases.delta_windows([list(s) if isinstance(s, (list, tuple)) else s for s in seed])
    reach = [0] + [len(s) // 2 if isinstance(s, (list, tuple)) else s for s in seed]
    kinds, width = rows.shape
    half = (width - 1) // 2
    design = np.zeros((size, kinds, size))
    for t in range(size):
        for h in range(kinds):
            # a dynamic row whose window leaves the sequence says nothing
            if half <= t < size - half or (reach[h] <= t and reach[h] < size - t):
                low, high = max(0, t - half), min(size, t + half + 1)
                design[t, h, low:high] = rows[h, low - t + half : high - t + half]
    flat = design.reshape(size * kinds, size)
    return np.linalg.solve(flat.T @ flat, flat.T)


def mlpg(u: Column | str, size: int, seed=((-0.5, 0, 0.5), (1, -2, 1)), dims: int = 1) -> Column:
    """Static tracks (size x dims, one after another) of vectors of size x kinds x dims features."""
    solve = mlpg_matrix(size, seed)
    kinds = solve.shape[1] // size
    return batched(lambda x: np.einsum("nkd,tk->ntd", x.reshape(len(x), size * kinds, dims), solve).reshape(len(x), -1), u)


def element(x: Column, k: int) -> Column:
    return whole(x, k)
