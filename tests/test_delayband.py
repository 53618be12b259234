"""Aperiodicity by group delay against one frame at a time, written from the formulas."""

import numpy as np
import pytest

from wavelath.functions import bases
from wavelath.operators import delayband

from .test_sequences import got, seq

RATE = 16000


def one_frame(x, centre, f0, rate):
    """Levels in dB of one place of a whole signal."""
    size = delayband.transform_length(rate, 4, 47)

    def part(periods, late, blackman):
        half = int(periods / 2 * rate / f0 + 0.5)
        origin = centre + int(np.floor(late * rate / f0 + 0.5))
        out, weights = [], []
        for n in range(-half, half + 1):
            turn = np.pi * n * f0 * 2 / periods / rate
            weights.append(0.42 + 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn) if blackman else 0.5 + 0.5 * np.cos(turn))
            out.append((x[origin + n] if 0 <= origin + n < len(x) else 0.0) * weights[-1])
        out, weights = np.array(out), np.array(weights)
        return out - weights * out.sum() / weights.sum()

    f = np.arange(size // 2 + 1) * rate / size
    fold = lambda s: np.array([v + (np.interp(f0 - g, f, s) if g < f0 else 0) for g, v in zip(f, s)])

    def smooth(s, width):
        """The mean of steps a bin wide, mirrored at both ends."""
        both = np.concatenate([s[:0:-1], s, s[-2::-1]])
        edges = (np.arange(len(both) + 1) - len(s) + 0.5) * rate / size
        area = np.concatenate([[0], np.cumsum(both)]) * rate / size
        return (np.interp(f + width / 2, edges, area) - np.interp(f - width / 2, edges, area)) / width

    total = 0
    for late in (-0.25, 0.25):
        y = part(4, late, True)
        y = y / np.sqrt((y**2).sum())
        a, b = np.fft.rfft(y, size), np.fft.rfft(y * np.arange(1, len(y) + 1), size)
        total = total + a.real * b.real + a.imag * b.imag
    delay = smooth(fold(total) / (smooth(fold(np.abs(np.fft.rfft(part(4, 0, False), size)) ** 2), f0) + 1e-12), f0 / 2)
    delay = delay - smooth(delay, f0)
    w = bases.window_values(3000 * size // rate * 2 + 1, "nuttall")
    out = []
    for k in range(int(min(15000, rate / 2 - 3000) / 3000)):
        middle = 3000 * (k + 1) * size // rate
        p = np.sort(np.abs(np.fft.rfft(delay[middle - len(w) // 2 : middle + len(w) // 2 + 1] * w, size)) ** 2)
        out.append(min(0.0, 10 * np.log10(p[: -(round(size * 8 / len(w)) + 1)].sum() / p.sum()) + (f0 - 100) / 50))
    return out


@pytest.mark.parametrize("rate", [16000, 48000])
def test_against_one_frame_at_a_time(spark, rate):
    rng = np.random.default_rng(0)
    n = np.arange(12000)
    x = sum(np.cos(2 * np.pi * 140 * k / rate * n + k * k) for k in range(1, 40)) + rng.normal(size=len(n))
    pitch = [140.0, 200.0, 0.0, 93.0, None, 400.0]
    f0 = spark.createDataFrame([(0, t, v) for t, v in enumerate(pitch)], "seq int, t long, x double")
    found = got(delayband.ap_group_delay(seq(spark, x), f0, 2000, rate), "t")[0]
    expected = [one_frame(x, 2000 * t, 150.0 if not v or v < 40 else v, rate) for t, v in enumerate(pitch)]
    np.testing.assert_allclose(found, expected, atol=1e-6)


def test_noise_raises_the_level(spark):
    """A clean sound is far below noise, and each share of noise between them is heard as more than the one before."""
    n = np.arange(8000)
    clean = sum(np.cos(2 * np.pi * 125 * k / RATE * n + k * k) for k in range(1, 64))
    noise = np.random.default_rng(1).normal(size=len(n)) * np.sqrt((clean**2).mean())
    rows = [np.sqrt(1 - p) * clean + np.sqrt(p) * noise for p in (0, 0.01, 0.1, 0.3, 0.6, 1)]
    f0 = spark.createDataFrame([(s, t, 125.0) for s in range(len(rows)) for t in range(15)], "seq int, t long, x double")
    found = got(delayband.ap_group_delay(seq(spark, *rows), f0, 500, RATE), "t")
    level = [np.mean(v[2:]) for v in found]
    assert (np.diff(level) > 0).all() and level[0] < -45 and level[1] < -22 and level[-1] > -4


def test_bins_silence_and_the_voicing_threshold(spark):
    n = np.arange(4000)
    voice, hiss = sum(np.cos(2 * np.pi * 125 * k / RATE * n) for k in range(1, 30)), np.sin(2 * np.pi * 6000 / RATE * n)
    f0 = spark.createDataFrame([(s, t, 125.0) for s in range(3) for t in range(5)], "seq int, t long, x double")
    found = got(delayband.ap_group_delay(seq(spark, voice, hiss, np.zeros(4000)), f0, 500, RATE, 512, threshold=0.85), "t")
    voiced, hissed, silent = (own[4] for own in found)
    assert len(voiced) == 257 and voiced[0] == pytest.approx(1e-3) and voiced[-1] == pytest.approx(1) and voiced[96] < 0.3
    assert set(hissed) == {1.0} and silent[150] == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError, match="12000"):
        delayband.ap_group_delay(seq(spark, [1.0]), f0, 10, 8000)
