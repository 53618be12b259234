"""What works in blocks gives what the whole sequence gives: long sequences over many small blocks, gaps, nulls, repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelath.operators import blocks, filters, sequences, spectra

COUNT = 700


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=COUNT)


def rows(spark, x, seq=0):
    return spark.createDataFrame([(seq, n, None if v is None or np.isnan(v) else float(v)) for n, v in enumerate(x)], "seq int, n long, x double")


def values(df):
    found = sorted((r["n"], r["x"]) for r in df.collect())
    assert [n for n, _ in found] == list(range(len(found)))
    return np.array([v for _, v in found], float)


def frames(spark, array):
    return spark.createDataFrame([(0, t, [float(v) for v in r]) for t, r in enumerate(array)], "seq int, t long, x array<double>")


def test_taps(spark, x):
    taps = np.random.default_rng(1).normal(size=(3, 91))
    y = values(sequences.fir(rows(spark, x), taps))
    np.testing.assert_allclose(y, np.stack([np.convolve(x, t)[:COUNT] for t in taps], 1), atol=1e-9)
    held = values(sequences.fir(rows(spark, x), taps, 50, hold_end=40))
    wide = np.concatenate([x, np.full(40, x[-1])])
    np.testing.assert_allclose(held, np.stack([np.convolve(wide, t)[40 : 40 + COUNT] for t in taps], 1), atol=1e-9)


def test_shuffled_rows_do_not_grow_with_taps(spark, x):
    for left, right in ((0, 0), (500, 0), (40, 23), (1000, 1000)):
        size = max(blocks.SIZE, left + right)
        assert blocks.sent(rows(spark, x), left, right, size).count() <= 2 * COUNT


def test_a_hot_sequence_is_many_blocks(spark, x):
    sent = blocks.sent(rows(spark, x), 8, 8, 64)
    most = sent.groupBy("seq", "block").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 80 and most[1] == 11


@pytest.mark.parametrize("length", [1, 4, 9, 200])
def test_medians(spark, x, length):
    y = x.round(1)
    y[::7] = np.nan
    y[100:140] = np.nan
    left, right = length // 2, (length - 1) // 2
    wide = np.concatenate([np.full(left, np.nan), y, np.full(right, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(wide, length)
    with np.errstate(all="ignore"):
        expected = np.array([np.median(w[~np.isnan(w)]) if (~np.isnan(w)).any() else np.nan for w in windows])
    np.testing.assert_allclose(values(sequences.medfilt(rows(spark, y), length)), expected)
    magic = np.array([0.5 if 2 * (w == 0.5).sum() > (~np.isnan(w)).sum() else np.median(w[~np.isnan(w) & (w != 0.5)]) if (~np.isnan(w) & (w != 0.5)).any() else np.nan for w in windows])
    np.testing.assert_allclose(values(sequences.medfilt(rows(spark, y), length, 0.5)), magic)


def test_repeated_rows_and_gaps(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, 5.0), (0, 200, 4.0), (1, 0, None), (None, 0, 3.0), (None, 1, 1.0)], "seq int, n long, x double")
    found = {(r["seq"], r["n"]): r["x"] for r in sequences.fir(df, [1.0, 0.5]).collect()}
    assert found[0, 0] == 3 and found[0, 1] == 6.5 and found[0, 2] == 2.5 and found[0, 200] == 4 and found[1, 0] == 0 and found[None, 0] == 3 and found[None, 1] == 2.5
    median = {(r["seq"], r["n"]): r["x"] for r in sequences.medfilt(df, 3).collect()}
    assert median[0, 0] == 2 and median[0, 1] == 2 and median[0, 200] == 4 and median[1, 0] is None and median[None, 0] == 2


def test_recursions(spark, x):
    y = x.copy()
    y[::9] = np.nan
    b, a = [0.5, 0.2, -0.1], [2.0, -1.6, 0.7]
    z, flat = np.zeros(COUNT), np.nan_to_num(y)
    for n in range(COUNT):
        z[n] = sum(2.0 * b[k] * flat[n - k] for k in range(3) if n >= k) - sum(a[k] * z[n - k] for k in (1, 2) if n >= k)
    np.testing.assert_allclose(values(filters.dfs(rows(spark, y), b, a)), z, atol=1e-9)


def test_recursions_over_gaps(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 400, 1.0)], "seq int, n long, x double")
    found = {r["n"]: r["x"] for r in filters.dfs(df, None, [1.0, -0.99]).collect()}
    assert found[10] == pytest.approx(0.99**10) and found[400] == pytest.approx(1 + 0.99**400)


def test_gammatone(spark, x):
    found = values(filters.gammatone(rows(spark, x), 8000, f_min=500, f_max=1500))
    _, channels = filters.gammatone_filters(8000, f_min=500, f_max=1500)
    for k, (num, den) in enumerate(channels):
        h = filters.impulse_response(num, den, COUNT)
        y = np.convolve(x, h)[:COUNT]
        np.testing.assert_allclose(found[:, k], y.real, atol=1e-8)
        np.testing.assert_allclose(found[:, k + len(channels)], y.imag, atol=1e-8)


@pytest.mark.parametrize("compensate", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_gammatone_round_trip(spark, compensate, exact):
    """Near-perfect: a sine inside the covered range comes back, delayed where the delay is not taken out."""
    n = np.arange(COUNT)
    sine = np.sin(2 * np.pi * 1000 * n / 16000) * np.hanning(COUNT)
    bands = filters.gammatone(rows(spark, sine), 16000, exact, f_min=100, f_max=6700)
    y = values(filters.igammatone(bands, 16000, compensate_delay=compensate, exact=exact, f_min=100, f_max=6700))
    shift = 0 if compensate else 64
    assert np.abs(y[200 : COUNT - 100] - sine[200 - shift : COUNT - 100 - shift]).max() < 0.1


def test_followed(spark, x):
    period = 16
    h = np.random.default_rng(2).normal(size=(-(-COUNT // period), 40))
    t, share = np.arange(COUNT) // period, (np.arange(COUNT) % period) / period
    each = h[t] + (h[np.minimum(t + 1, len(h) - 1)] - h[t]) * share[:, None]
    for zero in (0, 11, 39):
        expected = [sum(each[n, k] * x[n + zero - k] for k in range(40) if 0 <= n + zero - k < COUNT) for n in range(COUNT)]
        np.testing.assert_allclose(values(filters.zerodf(rows(spark, x), frames(spark, h), period, zeroth_index=zero, taps=40)), expected, atol=1e-9)
    short = h[:, :20]
    expected = [sum(each[n, k] * x[n - k] for k in range(20) if n >= k) for n in range(COUNT)]
    np.testing.assert_allclose(values(filters.zerodf(rows(spark, x), frames(spark, short), period)), expected, atol=1e-9)


def test_poles(spark, x):
    period = 16
    a = np.column_stack([np.full(44, 1.5), np.random.default_rng(3).uniform(-0.45, 0.45, size=(44, 2))])
    t, share = np.arange(COUNT) // period, (np.arange(COUNT) % period) / period
    each = a[t] + (a[np.minimum(t + 1, 43)] - a[t]) * share[:, None]
    y = np.zeros(COUNT)
    for n in range(COUNT):
        y[n] = each[n, 0] * x[n] - sum(each[n, k] * y[n - k] for k in (1, 2) if n >= k)
    for order in (None, 2):
        np.testing.assert_allclose(values(filters.poledf(rows(spark, x), frames(spark, a), period, order=order)), y, atol=1e-9)
    assert len(values(filters.poledf(rows(spark, x), frames(spark, a[:20]), period))) == 320


@pytest.mark.parametrize("phase", filters.PHASES)
def test_stages_in_blocks(spark, x, phase):
    mc = np.random.default_rng(4).normal(size=(44, 4)) * 0.1
    a = values(filters.mglsadf(rows(spark, x), frames(spark, mc), 16, phase=phase, mode="multi-stage", ir_length=9, n_fft=64, taylor_order=6))
    plain = np.zeros((44, 9))
    plain[:, 1:4] = mc[:, 1:]
    kernel = plain if phase == "minimum" else plain[:, ::-1] if phase == "maximum" else np.column_stack([plain[:, :0:-1] / 2, plain[:, :1], plain[:, 1:] / 2])
    zero = 0 if phase == "minimum" else 8
    t, share = np.arange(COUNT) // 16, (np.arange(COUNT) % 16) / 16
    line = lambda v: v[t] + (v[np.minimum(t + 1, 43)] - v[t]) * (share if v.ndim == 1 else share[:, None])
    h, y = line(kernel), x.copy()  # stages over the whole sequence, one after another
    for k in range(6, 0, -1):
        y = x + filters.varying(y, h, zero) / k
    np.testing.assert_allclose(a, y * np.exp(line(mc[:, 0])), atol=1e-9)


def plain_griffin(power, length, period, fft, out_length, n_iter, left, mode, alpha=0.99, beta=0.99, gamma=1.1):
    """One utterance as a whole."""
    from wavelath.functions import bases

    w = bases.window_values(length, "blackman", "power", True)
    total = (len(power) - 1) * period + length
    size, norm = np.sqrt(power + 1e-16), np.zeros(total)
    for t in range(len(power)):
        norm[t * period : t * period + length] += w**2

    def signal(z):
        y = np.zeros(total)
        for t, s in enumerate(np.fft.irfft(z, fft)[:, :length]):
            y[t * period : t * period + length] += s * w
        y /= norm + 1e-16
        own = y[left : left + out_length]
        return np.pad(own, (left, total - left - out_length), {"constant": "constant", "replicate": "edge", "reflect": "reflect"}[mode])

    def project(z):
        y = signal(z)
        return np.array([np.fft.rfft(y[t * period : t * period + length] * w, fft) for t in range(len(power))])

    unit = np.ones(size.shape, complex)
    before = lead = None
    for _ in range(n_iter):
        z = project(size * unit)
        z = z if before is None else (1 - gamma) * lead + gamma * z
        ahead, lead = (z, z) if before is None else (z + alpha * (z - before), z + beta * (z - before))
        before, unit = z, ahead / (np.abs(ahead) + 1e-16)
    return signal(size * unit)[left : left + out_length]


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("mode", ["constant", "replicate", "reflect"])
def test_phase_recovery_in_blocks(spark, center, mode):
    n = np.arange(9000)
    x = np.sin(0.3 * n + 2e-5 * n**2)
    power = spectra.stft(rows(spark, x), 16, 4, 16, center=center)
    found = values(filters.griffin(power, 16, 4, 16, len(x), n_iter=4, center=center, mode=mode))
    frames_ = np.array([r["x"] for r in power.orderBy("t").collect()])
    expected = plain_griffin(frames_, 16, 4, 16, len(x), 4, 8 if center else 0, mode)
    assert len(frames_) > 2 * 1024
    np.testing.assert_allclose(found, expected, atol=1e-6)
    assert len(values(filters.griffin(power, 16, 4, 16, n_iter=1, center=center))) == len(frames_) * 4


def test_lines_and_bands(spark, x):
    y = values(sequences.linear_intpl(rows(spark, x), 3))
    np.testing.assert_allclose(y, np.interp(np.arange(3 * COUNT) / 3, np.arange(COUNT), x), atol=1e-12)
    bands = spectra.pqmf(rows(spark, x), 4, 63)
    again = values(spectra.ipqmf(bands, 4, 63))
    assert np.corrcoef(again[80:-80], x[80:-80])[0, 1] > 0.99


def test_octave_bands_add_up():
    for order in (200, 1000):
        h = spectra.octave_filters(16000, 40, 1000, 8000, order)
        gain = np.abs(np.fft.rfft(h.sum(0), 4096))
        assert np.abs(gain[20:-200] - 1).max() < 0.02


def test_line_spectra_are_those_of_the_predictor(spark):
    from wavelath.operators import prediction

    x = np.random.default_rng(5).normal(size=(20, 64))
    df = spark.createDataFrame([(0, t, r.tolist()) for t, r in enumerate(x)], "seq int, t long, x array<double>").withColumn("a", prediction.lpc("x", 7))
    both = df.select("a", prediction.lsp2sp(prediction.lpc2lsp("a"), 64).alias("s")).collect()
    for r in both:
        a = np.array(r["a"])
        np.testing.assert_allclose(r["s"], a[0] ** 2 / np.abs(np.fft.rfft(np.concatenate([[1], a[1:]]), 64)) ** 2, rtol=1e-6)


def test_rows_without_time_or_key_are_counted(spark):
    from wavelath.sources import samples as src

    given = spark.sql("SELECT * FROM VALUES (1, timestamp '2024-01-02', 1, 1.0D), (1, NULL, 2, 2.0D), (NULL, timestamp '2024-01-01', 3, 3.0D), (1, timestamp '2024-01-01', 4, NULL), (1, NULL, NULL, 5.0D) AS t(k, ts, tie, v)")
    found = {(r["seq"], r["n"]): r["x"] for r in src.numbered(given, "k", "ts", "tie", "v").collect()}
    assert found == {(1, 0): None, (1, 1): 1.0, (1, 2): 2.0, (1, 3): 5.0, (None, 0): 3.0}


def test_null_samples_in_streams_and_tables(spark):
    x = [0.0, 1.0, None, 2.0, None]
    assert values(filters.dfs(rows(spark, x), None, [1.0, -0.5])).tolist() == [0, 1, 0.5, 2.25, 1.125]
    assert [r["n"] for r in filters.drc(rows(spark, x), 8000).orderBy("n").collect()] == [0, 1, 3]


def test_constant_q_in_blocks(spark):
    """Long filters over many short blocks: the spectrum by its definition, and the signal back from it."""
    from wavelath.operators import voice

    n = np.arange(COUNT)
    x = np.sin(2 * np.pi * 700 * n / 8000) + 0.5 * np.sin(2 * np.pi * 1100 * n / 8000)
    found = voice.cqt(rows(spark, x), 5, 8000, 300, 24, 12)
    z = np.zeros((140, 24), complex)
    for r in found.collect():
        z[r["t"], r["k"]] = r["re"] + 1j * r["im"]
    _, length, kernels = voice.constant_q(8000, 300, 24, 12, 0, 1, 1, "hann")
    wide = np.concatenate([np.zeros(1000), x, np.zeros(1000)])
    for k in (0, 11, 23):
        begin = 1000 + int(np.floor(-length[k] / 2))
        expected = [np.sum(kernels[k].conj() * wide[begin + 5 * t : begin + 5 * t + len(kernels[k])]) * np.sqrt(length[k]) for t in range(140)]
        np.testing.assert_allclose(z[:, k], expected, atol=1e-9)
    y = values(voice.icqt(found, 5, 8000, COUNT, 300, 24, 12))
    assert np.corrcoef(y[200:-200], x[200:-200])[0, 1] > 0.99


def two_sided(mc, phase):
    """Coefficients of both signs of time that give the phase."""
    if phase == "maximum":
        return np.column_stack([mc[:, :0:-1], mc[:, :1], 0 * mc[:, 1:]])
    if phase == "minimum":
        return np.column_stack([0 * mc[:, 1:], mc])
    return np.column_stack([mc[:, :0:-1] / 2, mc[:, :1], mc[:, 1:] / 2])


@pytest.mark.parametrize("phase", filters.PHASES)
@pytest.mark.parametrize("mode", ["single-stage", "multi-stage", "freq-domain"])
@pytest.mark.parametrize("ignore_gain", [True, False])
def test_mixed_phase_holds_the_others(spark, x, phase, mode, ignore_gain):
    mc = np.random.default_rng(6).normal(size=(44, 4)) * 0.1
    same = dict(alpha=0.2, mode=mode, ir_length=20, n_fft=128, taylor_order=8, ignore_gain=ignore_gain)
    a = values(filters.mglsadf(rows(spark, x), frames(spark, mc), 16, phase=phase, **same))
    b = values(filters.mglsadf(rows(spark, x), frames(spark, two_sided(mc, phase)), 16, phase="mixed", **same))
    np.testing.assert_allclose(a, b, atol=1e-6)


@pytest.mark.parametrize("order", [3, 5, 8])
def test_rational_synthesis(spark, x, order):
    mc = np.random.default_rng(7).normal(size=(44, 5)) * 0.15
    a = values(filters.mglsadf(rows(spark, x), frames(spark, mc), 16, alpha=0.2, ir_length=60, n_fft=256, mode="pade-approx", pade_order=order))
    b = values(filters.mglsadf(rows(spark, x), frames(spark, mc), 16, alpha=0.2, ir_length=60, n_fft=256, mode="multi-stage", taylor_order=30))
    assert np.corrcoef(a, b)[0, 1] > 0.999 and np.abs(a - b).max() < 0.1
    with pytest.raises(ValueError):
        filters.mglsadf(rows(spark, x), frames(spark, mc), 16, mode="pade-approx", phase="zero")


def test_rational_coefficients():
    np.testing.assert_allclose(filters.pade(2), [1, 1 / 2, 1 / 12])
    w = filters.pade(5)
    assert np.polyval(w[::-1], 0.7) / np.polyval(w[::-1], -0.7) == pytest.approx(np.exp(0.7), rel=1e-10)


@pytest.mark.parametrize("times", [(1, 500), (50, 20), (3, 3)])
def test_compressor_in_blocks(spark, times):
    """Equal to one pass over the whole sequence, over a block without samples and places that are null."""
    rng = np.random.default_rng(5)
    n = np.concatenate([np.arange(900), np.arange(1400, 3000)])
    x = np.sin(n / 9) * (0.1 + 0.9 * (np.sin(n / 150) > 0)) + 0.01 * rng.normal(size=len(n))
    df = spark.createDataFrame([(0, int(k), float(v)) for k, v in zip(n, x)] + [(0, 950, None), (1, 0, 0.5), (None, 3, 0.7), (None, 4, 0.1)], "seq int, n long, x double")
    fall, rise = (1 - np.exp(-1000 / (ms * 8000)) for ms in times)

    def plain(values):
        gain, out = 1.0, []
        for v in values:
            wanted = 10 ** (min(0.0, (-30 - 20 * np.log10(abs(v) + 1e-10)) * 0.75) / 20)
            gain += (fall if wanted < gain else rise) * (wanted - gain)
            out.append(gain * v)
        return out

    found = filters.drc(df, 8000, -30, 4, *times, block=200).collect()
    assert sorted((r["seq"] is None, r["seq"], r["n"]) for r in found if r["seq"] is not None) == [(False, 0, int(k)) for k in n] + [(False, 1, 0)]
    np.testing.assert_allclose([r["x"] for r in sorted((r for r in found if r["seq"] == 0), key=lambda r: r["n"])], plain(x), rtol=0, atol=1e-12)
    np.testing.assert_allclose(sorted(r["x"] for r in found if r["seq"] is None), sorted(plain([0.7, 0.1])), atol=1e-12)
