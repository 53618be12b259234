"""Frequency scales and the all-pass constant."""

from __future__ import annotations

import numpy as np

SCALES = ("htk", "mel", "inverted-mel", "bark", "linear")


def hz_to_scale(f, scale: str = "htk"):
    f = np.asarray(f, float)
    if scale == "htk":
        return 1127.0 * np.log1p(f / 700.0)
    if scale == "mel":
        return 2595.0 * np.log10(1 + f / 700.0)
    if scale == "inverted-mel":
        return 2195.286 - 2595.0 * np.log10(1 + (4031.25 - f) / 700)
    if scale == "bark":
        return 26.81 * f / (1960 + f) - 0.53
    if scale == "linear":
        return f
    raise ValueError(f"scale is one of {SCALES}")


def scale_to_hz(z, scale: str = "htk"):
    z = np.asarray(z, float)
    if scale == "htk":
        return 700.0 * np.expm1(z / 1127.0)
    if scale == "mel":
        return 700.0 * (10 ** (z / 2595.0) - 1)
    if scale == "inverted-mel":
        return 4031.25 - 700 * (10 ** ((2195.286 - z) / 2595) - 1)
    if scale == "bark":
        return 1960 * (z + 0.53) / (26.28 - z)
    if scale == "linear":
        return z
    raise ValueError(f"scale is one of {SCALES}")


#: The customary all-pass constant of each sample rate.
ALPHA = {8000: 0.31, 10000: 0.35, 12000: 0.37, 16000: 0.42, 22050: 0.45, 24000: 0.47, 32000: 0.50, 44100: 0.53, 48000: 0.55}


def warped(omega: np.ndarray, alpha: float) -> np.ndarray:
    """The phase of a first-order all-pass section."""
    return omega + 2 * np.arctan(alpha * np.sin(omega) / (1 - alpha * np.cos(omega)))


def get_alpha(sample_rate: int, mode: str = "hts", n_freq: int = 10, n_alpha: int = 100) -> float:
    """The all-pass constant whose warping comes nearest to the mel scale; mode hts takes the customary one."""
    if mode == "hts":
        return ALPHA[sample_rate]
    if mode != "auto":
        raise ValueError("mode is hts or auto")
    omega = np.arange(n_freq) * (np.pi / (n_freq - 1))
    mel = np.log1p(omega * (sample_rate / 2 / np.pi) / 1000)
    mel *= np.pi / mel[-1]
    tries = np.arange(n_alpha) / n_alpha
    errors = [np.sum((warped(omega, a) - mel) ** 2) for a in tries]
    return float(tries[int(np.argmin(errors))])
