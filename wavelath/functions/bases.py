"""Windows and constant matrices, computed on the driver from their formulas."""

from __future__ import annotations

import numpy as np

from .scales import warped

WINDOWS = ("blackman", "hamming", "hanning", "bartlett", "trapezoidal", "rectangular", "nuttall", "povey", "sine", "vorbis", "kbd")
NORMS = ("none", "power", "magnitude")


def cosine_sum(weights: list[float], length: int, span: int) -> np.ndarray:
    n = np.arange(length) / max(span, 1)
    return sum(w * np.cos(2 * np.pi * k * n) for k, w in enumerate(weights))


def window_values(length: int, window: str | int = "blackman", norm: str | int = "none", symmetric: bool = True) -> np.ndarray:
    """A window's values; window and norm by name or place in WINDOWS and NORMS."""
    window = WINDOWS[window] if isinstance(window, int) else window
    norm = NORMS[norm] if isinstance(norm, int) else norm
    if length < 1:
        raise ValueError("a window has one value at least")
    span = length - 1 if symmetric else length
    hann = cosine_sum([0.5, -0.5], length, span)
    triangle = 1 - np.abs(2 * np.arange(length) / max(span, 1) - 1)
    if length == 1:
        w = np.ones(1)
    elif window == "blackman":
        w = cosine_sum([0.42, -0.5, 0.08], length, span)
    elif window == "hamming":
        w = cosine_sum([0.54, -0.46], length, span)
    elif window == "hanning":
        w = hann
    elif window == "bartlett":
        w = triangle
    elif window == "trapezoidal":
        w = np.minimum(2 * triangle, 1)
    elif window == "rectangular":
        w = np.ones(length)
    elif window == "nuttall":
        w = cosine_sum([0.355768, -0.487396, 0.144232, -0.012604], length, span)
    elif window == "povey":
        w = np.maximum(hann, 0) ** 0.85
    elif window in ("sine", "vorbis"):
        w = np.sin(np.pi * (np.arange(length) + 0.5) / (length if symmetric else length + 1))
        w = w if window == "sine" else np.sin(0.5 * np.pi * w**2)
    elif window == "kbd" and symmetric:
        rising = np.cumsum(np.kaiser(length // 2 + 1, 12.0))
        half = np.sqrt(rising[:-1] / rising[-1])
        w = np.concatenate([half, half[::-1]])
    else:
        raise ValueError(f"window is one of {WINDOWS}; kbd is symmetric")
    if norm == "power":
        return w / np.sqrt(np.sum(w**2))
    if norm == "magnitude":
        return w / np.sum(w)
    if norm != "none":
        raise ValueError(f"norm is one of {NORMS}")
    return w


def dct_matrix(length: int, kind: int = 2) -> np.ndarray:
    """Orthonormal cosine transform of types 1 to 4, rows are frequencies."""
    return _trigonometric(np.cos, length, kind, sine=False)


def dst_matrix(length: int, kind: int = 2) -> np.ndarray:
    return _trigonometric(np.sin, length, kind, sine=True)


def _trigonometric(fn, length: int, kind: int, sine: bool) -> np.ndarray:
    if kind not in (1, 2, 3, 4):
        raise ValueError("types are 1 to 4")
    n = np.arange(length, dtype=float)
    k = n[:, None]
    if kind == 1:
        if not sine:
            edge = np.ones(length)
            edge[[0, -1]] = np.sqrt(0.5)
            return np.sqrt(2 / max(length - 1, 1)) * edge * edge[:, None] * fn(np.pi / max(length - 1, 1) * k * n)
        return np.sqrt(2 / (length + 1)) * fn(np.pi / (length + 1) * (k + 1) * (n + 1))
    edge = np.ones(length)
    edge[-1 if sine else 0] = np.sqrt(0.5)
    shift = 1.0 if sine else 0.0
    if kind == 2:
        return np.sqrt(2 / length) * edge[:, None] * fn(np.pi / length * (k + shift) * (n + 0.5))
    if kind == 3:
        return np.sqrt(2 / length) * edge * fn(np.pi / length * (k + 0.5) * (n + shift))
    return np.sqrt(2 / length) * fn(np.pi / length * (k + 0.5) * (n + 0.5))


INVERSE = {1: 1, 2: 3, 3: 2, 4: 4}


def dht_matrix(length: int, kind: int = 2) -> np.ndarray:
    """Hartley transform of types 1 to 4: cas(x) = cos x + sin x."""
    if kind not in (1, 2, 3, 4):
        raise ValueError("types are 1 to 4")
    k = np.arange(length)[:, None] + (0.5 if kind in (3, 4) else 0.0)
    n = np.arange(length) + (0.5 if kind in (2, 4) else 0.0)
    x = 2 * np.pi / length * k * n
    return (np.cos(x) + np.sin(x)) / np.sqrt(length)


def wht_matrix(length: int, kind: str | int = "natural") -> np.ndarray:
    """Walsh-Hadamard transform in sequency, natural or dyadic order."""
    bits = length.bit_length() - 1
    if length != 1 << bits:
        raise ValueError("the length is a power of two")
    kind = {1: "sequency", 2: "natural", 3: "dyadic"}.get(kind, kind)
    rows = np.arange(length)
    if kind == "sequency":
        rows = rows ^ rows >> 1
    elif kind not in ("natural", "dyadic"):
        raise ValueError("order is sequency, natural or dyadic")
    if kind != "natural":
        rows = np.array([int(f"{r:0{bits}b}"[::-1], 2) if bits else 0 for r in rows])
    odd = np.bitwise_count(rows[:, None] & np.arange(length)) & 1
    return np.where(odd, -1.0, 1.0) / np.sqrt(length)


def lapped_matrix(length: int, window: str | int = "sine", sine: bool = False) -> np.ndarray:
    """Windowed basis of the modified cosine or sine transform, from frames of length to half as many bins.

    A window whose squares add up to 1 is scaled by the root of 2, so that the mean of two overlapping frames is the signal.
    """
    half = length // 2
    k, n = np.arange(half)[:, None] + 0.5, np.arange(length) + 0.5 + half / 2
    scale = 2 / half if window in ("rectangular", 5) else 4 / half
    return np.sqrt(scale) * (np.sin if sine else np.cos)(np.pi / half * k * n) * window_values(length, window)


def freqt_matrix(in_order: int, out_order: int, alpha: float) -> np.ndarray:
    """First-order all-pass warping of a cepstrum: column m holds the expansion of the warped z^-m."""
    # powers of the all-pass section (z^-1 + alpha) / (1 + alpha z^-1), term by term
    out = np.zeros((out_order + 1, in_order + 1))
    section = np.zeros(out_order + 1)
    section[0] = alpha
    if out_order:
        section[1:] = (1 - alpha * alpha) * (-alpha) ** np.arange(out_order)
    power = np.zeros(out_order + 1)
    power[0] = 1.0
    for m in range(in_order + 1):
        out[:, m] = power
        power = np.convolve(power, section)[: out_order + 1]
    return out


def second_order_phase(omega: np.ndarray, alpha: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Phase of a second-order all-pass section and its derivative; theta in units of pi."""
    out, slope = omega.copy(), np.ones_like(omega)
    for sign in (1, -1):
        x = omega - sign * theta * np.pi
        out = out + np.arctan2(alpha * np.sin(x), 1 - alpha * np.cos(x))
        slope = slope + alpha * (np.cos(x) - alpha) / (1 - 2 * alpha * np.cos(x) + alpha * alpha)
    return out, slope


def freqt2_matrix(in_order: int, out_order: int, alpha: float, theta: float, n_fft: int = 512, inverse: bool = False) -> np.ndarray:
    """Second-order all-pass warping of a cepstrum by integrals over the unit circle; rows are outputs."""
    omega = 2 * np.pi * np.arange(n_fft) / n_fft
    phase, slope = second_order_phase(omega, alpha, theta)
    rows, columns = np.arange(out_order + 1)[:, None], np.arange(in_order + 1)
    if inverse:
        # the even part of a cepstrum on the warped axis, read back on the plain one
        kernel = np.cos(columns[:, None] * phase) @ np.cos(rows[:, 0][:, None] * omega).T / n_fft
        kernel = kernel.T * np.where(rows == 0, 1.0, 2.0)
        return kernel
    kernel = (np.cos(rows * phase) * slope) @ np.cos(columns[:, None] * omega).T / n_fft
    return kernel * np.where(rows == 0, 1.0, 2.0)


def delta_windows(seed, static_out: bool = True) -> np.ndarray:
    """Rows of regression windows: lists of coefficients, or the half widths of first and second order regressions."""
    rows = [[1.0]] if static_out else []
    if isinstance(seed[0], (list, tuple)):
        rows += [list(map(float, s)) for s in seed]
    else:
        if min(seed) <= 0 or len(seed) > 2:
            raise ValueError("one or two positive half widths")
        j = np.arange(-seed[0], seed[0] + 1)
        rows.append(list(j / np.sum(j * j)))
        if len(seed) == 2:
            j = np.arange(-seed[1], seed[1] + 1).astype(float)
            square = j * j
            # least squares: the quadratic term, freed of its mean
            rows.append(list((square - square.mean()) / np.sum((square - square.mean()) ** 2) / 2))
    width = max(map(len, rows)) | 1
    out = np.zeros((len(rows), width))
    for r, row in zip(out, rows, strict=True):
        begin = (width - len(row)) // 2
        r[begin : begin + len(row)] = row
    return out


def toeplitz(first: np.ndarray) -> np.ndarray:
    """Symmetric Toeplitz matrices from rows of first columns."""
    n = np.arange(first.shape[-1])
    return first[..., np.abs(n[:, None] - n)]


def hankel(values: np.ndarray) -> np.ndarray:
    n = np.arange((values.shape[-1] + 1) // 2)
    return values[..., n[:, None] + n]


def warp_grid(fft_length: int, alpha: float) -> np.ndarray:
    return warped(np.linspace(0, np.pi, fft_length // 2 + 1), alpha)
