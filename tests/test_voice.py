"""Voice operators on signals whose answer is known."""

import numpy as np
import pytest

from wavelath.operators import voice

from .test_sequences import got, seq

RATE = 8000


def test_pitch_of_tones(spark):
    n = np.arange(1600)
    df = seq(spark, np.sin(2 * np.pi * 200 / RATE * n) + 0.4 * np.sin(2 * np.pi * 400 / RATE * n), np.zeros(1600), np.random.default_rng(0).normal(size=1600))
    f0 = got(voice.pitch(df, 400, RATE, out_format="f0"), "t")
    np.testing.assert_allclose(f0[0][1:3], 200, rtol=5e-3)
    assert f0[1] == [0] * 4 and sum(v > 0 for v in f0[2]) <= 1
    assert got(voice.pitch(df, 400, RATE, out_format="log-f0"), "t")[1] == [-1e10] * 4


def test_constant_q(spark):
    n = np.arange(2400)
    df = seq(spark, np.sin(2 * np.pi * 440 / RATE * n))
    rows = voice.cqt(df, 800, RATE, 220, 24, 12).filter("t = 1").orderBy("k").collect()
    size = [np.hypot(r["re"], r["im"]) for r in rows]
    assert [r["k"] for r in rows] == list(range(24)) and int(np.argmax(size)) == 12
    assert size[12] > 8 * size[9]


def test_constant_q_and_back(spark):
    n = np.arange(2400)
    x = np.sin(2 * np.pi * 440 / RATE * n) + 0.5 * np.sin(2 * np.pi * 600 / RATE * n + 1)
    df = seq(spark, x)
    back = got(voice.icqt(voice.cqt(df, 32, RATE, 220, 24, 12), 32, RATE, 2400, 220, 24, 12))[0]
    assert np.corrcoef(back[600:1800], x[600:1800])[0, 1] > 0.98


def test_envelope_follows_the_filter(spark):
    """Pulses through a resonance: the envelope has its peak, not the harmonics."""
    n = np.arange(1600)
    pulses = (n % 80 == 0).astype(float)
    x = np.zeros(1600)
    for k in range(1600):
        x[k] = pulses[k] + 1.8 * 0.95 * np.cos(2 * np.pi * 1000 / RATE) * (x[k - 1] if k else 0) - 0.9 * (x[k - 2] if k > 1 else 0)
    f0 = spark.createDataFrame([(0, t, 100.0) for t in range(4)], "seq int, t long, x double")
    y = got(voice.pitch_spec(seq(spark, x), f0, 400, RATE, 1024, out_format="db"), "t")[0][2]
    peak = np.argmax(y) * RATE / 1024
    assert 850 < peak < 1150
    assert np.abs(np.diff(np.diff(y[10:400]))).max() < 0.5


def test_bins_above_the_band_are_an_error(spark):
    with pytest.raises(ValueError, match="half the sample rate"):
        voice.cqt(seq(spark, [1.0]), 10, RATE, 2000, 24, 12)


def test_aperiodicity(spark):
    n = np.arange(1600)
    tone = sum(np.sin(2 * np.pi * 100 * k / RATE * n + k) for k in range(1, 39))
    df = seq(spark, tone, np.random.default_rng(0).normal(size=1600))
    f0 = spark.createDataFrame([(s, t, 0.0 if t == 3 else 100.0) for s in (0, 1) for t in range(4)], "seq int, t long, x double")
    a = got(voice.ap(df, f0, 400, RATE, 256), "t")
    assert max(a[0][2]) < 0.1 and np.median(a[1][2]) > 0.5 and a[0][3] == [0.999] * 129
    p = got(voice.ap(df, f0, 400, RATE, 256, out_format="p"), "t")
    np.testing.assert_allclose(np.array(p[0][2]) + np.array(a[0][2]), 1)


def test_synthesis_repeats_with_the_pitch(spark):
    frames = lambda value: spark.createDataFrame([(0, t, value) for t in range(20)], "seq int, t long, x array<double>")
    f0 = spark.createDataFrame([(0, t, 100.0) for t in range(20)], "seq int, t long, x double")
    flat, clean = frames([1.0] * 129), frames([0.001] * 129)
    x = np.zeros(1600)
    for r in voice.world_synth(f0, clean, flat, 80, RATE, 256).collect():
        x[r["n"]] = r["x"]
    c = np.correlate(x, x, "full")[1599:]
    assert np.argmax(c[40:120]) + 40 == 80 and c[80] > 0.8 * c[0]
    silent = spark.createDataFrame([(0, t, 0.0) for t in range(20)], "seq int, t long, x double")
    first = voice.world_synth(silent, clean, flat, 80, RATE, 256)
    values = np.array([r["x"] for r in first.orderBy("n").collect()])
    assert abs(np.corrcoef(values[:-16], values[16:])[0, 1]) < 0.2
    assert sorted(first.collect()) == sorted(voice.world_synth(silent, clean, flat, 80, RATE, 256).collect())
