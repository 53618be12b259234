"""Sequence operators against documented values, round trips and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelath.operators import filters, prediction, sequences, spectra
from wavelath.sources import samples as src


def seq(spark, *values):
    return spark.createDataFrame([(k, n, None if v is None else float(v)) for k, own in enumerate(values) for n, v in enumerate(own)], "seq int, n long, x double")


def got(df, place="n", column="x"):
    """The values of each sequence in order; places are whole numbers from 0 on."""
    out = {}
    for r in df.orderBy("seq", place).collect():
        out.setdefault(r["seq"], []).append((r[place], r[column]))
    for own in out.values():
        assert [p for p, _ in own] == list(range(len(own)))
    return [[v for _, v in out[k]] for k in sorted(out)]


def close(df, expected, place="n", tol=6e-4):
    found = got(df, place)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-3, atol=tol)


RAMP = list(range(20))


def test_frame(spark):
    df = seq(spark, range(1, 10))
    close(sequences.frame(df, 5, 2), [[[0, 0, 1, 2, 3], [1, 2, 3, 4, 5], [3, 4, 5, 6, 7], [5, 6, 7, 8, 9], [7, 8, 9, 0, 0]]], "t")
    close(sequences.unframe(sequences.frame(df, 5, 2), 5, 2, out_length=9), [list(range(1, 10))])


@pytest.mark.parametrize("mode", ["constant", "reflect", "replicate", "circular"])
@pytest.mark.parametrize("center", [True, False])
def test_frame_modes(spark, mode, center):
    x = np.arange(1.0, 12)
    length, period = 6, 4
    left = length // 2 if center else 0
    pad = np.pad(x, (left, length - 1 - left), {"constant": "constant", "reflect": "reflect", "replicate": "edge", "circular": "wrap"}[mode])
    expected = [[pad[t * period : t * period + length] for t in range(-(-len(x) // period))]]
    close(sequences.frame(seq(spark, x), length, period, center, mode=mode), expected, "t")


def test_short_null_and_repeated(spark):
    df = seq(spark, [5.0], [])
    close(sequences.frame(df, 4, 2), [[[0, 0, 5, 0]]], "t")
    assert sequences.frame(df.limit(0), 4, 2).collect() == []
    close(sequences.linear_intpl(df, 3), [[5, 5, 5]])
    assert got(sequences.medfilt(seq(spark, [1, None, 3]), 3)) == [[1, 2, 3]]


def test_delay(spark):
    df = seq(spark, [1, 2, 3], [9])
    close(sequences.delay(df, 2), [[0, 0, 1, 2, 3], [0, 0, 9]])
    close(sequences.delay(df, 2, keeplen=True), [[0, 0, 1], [0]])
    close(sequences.delay(seq(spark, [1, 2, 3]), -1), [[2, 3]])
    close(sequences.delay(df, -1, keeplen=True), [[2, 3, 0], [0]])


def test_resampling(spark):
    df = seq(spark, [0, 1, 2])
    close(sequences.linear_intpl(df, 2), [[0, 0.5, 1, 1.5, 2, 2]])
    close(sequences.decimate(seq(spark, range(7)), 3, 1), [[1, 4]])
    close(sequences.interpolate(df, 2, 1), [[0, 0, 0, 1, 0, 2, 0]])


def test_magic_and_median(spark):
    close(sequences.magic_intpl(seq(spark, [0, 1, 2, 0, 4, 0], [0, 0])), [[1, 1, 2, 3, 4, 4], [0, 0]])
    close(sequences.magic_intpl(seq(spark, [0, 1, 0, 0, 0, 5, 0, 0]), block=2), [[1, 1, 2, 3, 4, 5, 5, 5]])
    close(sequences.medfilt(seq(spark, [0, 2, -2, 7, 4, 8]), 3), [[1, 0, 2, 4, 7, 6]])


def test_running_sum_in_blocks(spark):
    rows = sequences.running_sum(seq(spark, range(10)), F.col("x"), "sum", block=3)
    assert got(rows, column="sum") == [list(np.cumsum(range(10)))]


def test_delta(spark):
    df = seq(spark, [1, 3, 5, 7])
    close(sequences.delta(df, [[-0.5, 0], [0, 0, 0.5]]), [[[1, -0.5, 1.5], [3, -0.5, 2.5], [5, -1.5, 3.5], [7, -2.5, 3.5]]])
    close(sequences.delta(df, [1], static_out=False), [[[1], [2], [2], [1]]])


def test_counts(spark):
    close(sequences.zcross(seq(spark, [-0.2, 0.3, -0.5, -0.7, 0.4, 0.2]), 3), [[2, 1]], "t")
    df = seq(spark, range(10))
    np.testing.assert_allclose(sequences.histogram(df, 4, 0, 9).first()["x"], [2.5, 2, 2, 2.5], atol=1e-3)
    np.testing.assert_allclose(sequences.histogram(df, 4, -0.1, 9.1, norm=True).first()["x"], np.array([3, 2, 2, 3]) / 10, atol=1e-3)
    frames = spark.createDataFrame([(0, t, [2.0 * t, 2 * t + 1.0]) for t in range(3)], "seq int, t long, x array<double>")
    assert [r["flux"] for r in sequences.flux(frames, norm=1, reduction="none").orderBy("t").collect()] == [4, 4]


def spectrum(spark, fft):
    return spectra.stft(seq(spark, RAMP), 10, 10, fft)


def test_stft(spark):
    close(spectra.stft(seq(spark, [1, 2, 3]), 3, 1, 8), [[[1] * 5, [4] * 5, [9] * 5]], "t")
    z = spectra.stft(seq(spark, [1, 2, 3]), 3, 1, 8, out_format="complex")
    close(spectra.istft(z, 3, 1, 8, out_length=3), [[1, 2, 3]])


FEATURES = {
    "fbank": (32, lambda x: spectra.fbank(x, 32, 4, 8000), [[0.1214, 0.4825, 0.6072, 0.3589], [3.3640, 3.4518, 2.7717, 0.5088]]),
    "fftcep": (16, lambda x: prediction.fftcep(x, 16, 3), [[-0.966, 0.819, -0.093, -0.015], [-0.854, 4.617, -0.55, -0.321]]),
    "mcep": (16, lambda x: prediction.mcep(x, 16, 3, 0.1, 1), [[-0.885, 0.792, -0.174, 0.017], [-0.352, 4.422, -1.088, -0.051]]),
    "mgcep": (16, lambda x: prediction.mgcep(x, 16, 3, 0.1, 0, n_iter=1), [[-0.8851, 0.7917, -0.1737, 0.0175], [-0.3522, 4.4222, -1.0882, -0.0510]]),
    "smcep": (16, lambda x: prediction.smcep(x, 16, 3, 0.1, 0.1, 1), [[-0.8889, 0.7930, -0.1700, 0.0159], [-0.3738, 4.4321, -1.0657, -0.0642]]),
    "mfcc": (32, lambda x: spectra.mfcc(x, 32, 4, 8, 8000), [[-0.34, -0.658, -0.021, -0.194], [4.553, -3.21, 1.319, -0.93]]),
    "plp": (32, lambda x: spectra.plp(x, 32, 4, 8, 8000), [[-0.2896, -0.2356, -0.0586, -0.0387], [0.4468, -0.5820, 0.0104, -0.0505]]),
    "mgc2sp": (16, lambda x: prediction.mgc2sp(prediction.mcep(x, 16, 3, 0.1, 1), 8, 0.1), [[6.0634e-01, 4.6702e-01, 1.7489e-01, 4.4821e-02, 2.3869e-02], [3.5678e02, 1.9434e02, 6.0081e-01, 2.4274e-04, 8.8505e-06]]),
}


@pytest.mark.parametrize("name", FEATURES)
def test_features(spark, name):
    fft, op, expected = FEATURES[name]
    close(spectrum(spark, fft).select("seq", "t", op(F.col("x")).alias("x")), [expected], "t", tol=3e-3)


def test_bank_inverse(spark):
    df = spectrum(spark, 32).select("seq", "t", spectra.fbank("x", 32, 4, 8000, use_power=True).alias("y"))
    again = df.select("y", spectra.ifbank("y", 4, 32, 8000, use_power=True).alias("x")).select("y", spectra.fbank("x", 32, 4, 8000, use_power=True).alias("z"))
    for r in again.collect():
        np.testing.assert_allclose(r["y"], r["z"], atol=1e-6)


def test_erb_bank():
    w = spectra.bank(512, 10, 16000, erb_factor=1.0)
    assert w.shape == (257, 10) and (w >= 0).all() and (w.max(0) > 0.5).all()


def test_chroma(spark):
    x = np.sin(2 * np.pi * 440 / 16000 * np.arange(501))
    y = spectra.stft(seq(spark, x), 512, 512, 512, window="hanning").select(spectra.chroma("x", 512, 12, 16000).alias("y")).first()["y"]
    np.testing.assert_allclose(y, [0.1146, 0.0574, 0.0457, 0.0468, 0.0519, 0.0789, 0.1736, 0.4285, 0.7416, 1.0, 0.7806, 0.3505], atol=2e-3)


def test_lapped(spark):
    df = seq(spark, [0, 1, 2, 3])
    close(spectra.mdct(df, 4), [[[-0.5, -0.2071], [-4.4142, -0.4142], [-1.0858, 2.6213]]], "t")
    close(spectra.mdst(df, 4), [[[-0.2071, -0.5], [1.5858, 0.4142], [4.6213, -1.9142]]], "t")
    for window in ("sine", "vorbis", "kbd"):
        close(spectra.imdct(spectra.mdct(df, 4, window), 4, window), [[0, 1, 2, 3]])
        close(spectra.imdst(spectra.mdst(df, 4, window), 4, window), [[0, 1, 2, 3]])


def test_pqmf(spark):
    bands = spectra.pqmf(seq(spark, [0, 0.25, 0.5, 0.75, 1]), 2, 10)
    close(bands, [list(zip([0.1605, 0.4266, 0.6927, 0.9199, 1.0302], [-0.0775, -0.0493, -0.0211, -0.0318, 0.0743]))])
    close(spectra.ipqmf(spectra.pqmf(seq(spark, [1, 2, 3, 4]), 2, 10), 2, 10), [[0.5372, 1.9768, 2.9893, 3.9759]])


def test_oband(spark):
    y = spectra.oband(seq(spark, [0, 0.25, 0.5, 0.75, 1]), 16000)
    sums = [sum(v) for v in got(y)[0]]
    assert len(got(y)[0][0]) == 9
    np.testing.assert_allclose(sums, [-0.0184, 0.0969, 0.3940, 0.6062, 0.9033], atol=1e-3)


def test_filters(spark):
    df = seq(spark, range(5))
    close(filters.dfs(df, [1, -0.97]), [[0, 1, 1.03, 1.06, 1.09]])
    one = seq(spark, [1, 0, 0, 0, 0])
    close(filters.df2(one, 16000, 1000, 200), [[1, 1.7766, 2.2319, 2.3227, 2.0633]])
    close(filters.df2(one, 16000, 1000, 200, ir_length=3), [[1, 1.7766, 2.2319, 0, 0]])


def test_recurrence_over_batches(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    b, a = [0.5, 0.2, -0.1], [1.0, -1.2, 0.5]
    y = np.zeros(3000)
    for n in range(3000):
        y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        close(filters.dfs(seq(spark, x, x[:10]), b, a), [y, y[:10]], tol=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frames(spark, *rows):
    return spark.createDataFrame([(0, t, [float(v) for v in r]) for t, r in enumerate(rows)], "seq int, t long, x array<double>")


def test_followed_filters(spark):
    step = seq(spark, [1] * 5)
    ramp = frames(spark, [0], [1], [2], [3], [4])
    close(filters.zerodf(step, ramp, 1), [[0, 1, 2, 3, 4]])
    close(filters.poledf(step, ramp, 1), [[0, 1, 2, 3, 4]])
    x = np.arange(1.0, 7)
    taps = np.array([[1.0, 0.5], [3.0, -1.0]])
    h = np.array([taps[0] + (taps[1] - taps[0]) * n / 3 if n < 3 else taps[1] for n in range(6)])
    expected = [h[n, 0] * x[n] + (h[n, 1] * x[n - 1] if n else 0) for n in range(6)]
    close(filters.zerodf(seq(spark, x), frames(spark, *taps), 3), [expected])
    close(filters.zerodf(seq(spark, x), frames(spark, *taps), 3, ignore_gain=True), [np.array(expected) / h[:, 0]])
    a = np.array([[2.0, 0.5], [1.0, -0.5]])
    g = np.array([a[0] + (a[1] - a[0]) * n / 3 if n < 3 else a[1] for n in range(6)])
    y = np.zeros(6)
    for n in range(6):
        y[n] = g[n, 0] * x[n] - (g[n, 1] * y[n - 1] if n else 0)
    close(filters.poledf(seq(spark, x), frames(spark, *a), 3), [y])


def test_mglsa(spark):
    y = seq(spark, [1] * 4)
    mc = frames(spark, [0.3, 0.5], [-0.2, 0.1])
    for mode in ("multi-stage", "single-stage"):
        found = got(filters.mglsadf(y, mc, 2, mode=mode, ir_length=8, taylor_order=5))[0]
        assert np.corrcoef(found, [1.3499, 1.3667, 0.9129, 0.9051])[0, 1] > 0.98
    x = seq(spark, np.random.default_rng(0).normal(size=40))
    still = frames(spark, *[[0.2, 0.3, 0.1]] * 10)
    there = filters.mglsadf(x, still, 4, alpha=0.2, ir_length=30, n_fft=128)
    close(filters.imglsadf(there, still, 4, alpha=0.2, ir_length=30, n_fft=128), got(x), tol=1e-3)


@pytest.mark.parametrize("phase", filters.PHASES)
def test_mglsa_modes_agree_on_still_frames(spark, phase):
    x = seq(spark, np.random.default_rng(1).normal(size=160))
    still = frames(spark, *[[0.2, 0.3, -0.1]] * 40)
    a, b = (np.array(got(filters.mglsadf(x, still, 4, phase=phase, mode=m, ir_length=16, n_fft=128, frame_length=32))[0]) for m in ("single-stage", "freq-domain"))
    assert np.corrcoef(a[30:-30], b[30:-30])[0, 1] > 0.999 and np.allclose(a[30:-30], b[30:-30], atol=0.05)


def test_mglsa_in_stages(spark):
    x = seq(spark, np.random.default_rng(1).normal(size=40))
    still = frames(spark, *[[0.2, 0.3, -0.1]] * 10)
    a, b = (np.array(got(filters.mglsadf(x, still, 4, mode=m, ir_length=8, n_fft=64, taylor_order=5))[0]) for m in ("single-stage", "multi-stage"))
    np.testing.assert_allclose(a, b, atol=2e-3)


def test_exact_gammatone():
    """The impulse response of an exact channel is n**3 times a power of its pole."""
    _, channels = filters.gammatone_filters(8000, True, f_min=900, f_max=1100)
    _, poles, _ = filters.gammatone_design(8000, 900, 1000, 1100)
    n = np.arange(50)
    for (num, den), pole in zip(channels, poles):
        h = filters.impulse_response(num, den, 50)
        shape = n**3 * pole**n
        np.testing.assert_allclose(h / h[1], shape / shape[1], rtol=1e-6, atol=1e-9)
        z = np.exp(-1j * np.angle(pole))
        assert abs(np.polyval(num[::-1], z) / np.polyval(den[::-1], z)) == pytest.approx(2)


def test_excite(spark):
    pitch = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "seq int, t long, x double")
    close(filters.excite(pitch, 3), [[1.4142, 0, 1.6330, 0, 0, 1.7321]])
    unvoiced = spark.createDataFrame([(0, 0, 0.0), (0, 1, 4.0)], "seq int, t long, x double")
    close(filters.excite(unvoiced, 4), [[0, 0, 0, 0, 2, 0, 0, 0]])
    close(filters.excite(unvoiced, 4, "square", polarity="unipolar"), [[0, 0, 0, 0, 1, 1, 0, 1]])
    noise = got(filters.excite(spark.createDataFrame([(0, t, 0.0) for t in range(50)], "seq int, t long, x double"), 40, unvoiced_region="gauss"))[0]
    assert abs(np.mean(noise)) < 0.1 and abs(np.var(noise) - 1) < 0.15


def test_gammatone(spark):
    x = np.zeros(200)
    x[0] = 1
    bands = filters.gammatone(seq(spark, x), 16000)
    assert len(bands.first()["x"]) == 60
    found = got(filters.igammatone(bands, 16000))[0]
    np.testing.assert_allclose(found[:5], [0.8349, 0.0682, -0.1085, 0.0559, -0.0947], atol=2e-3)


def test_drc(spark):
    x = np.sin(2 * np.pi * np.arange(8001) / 8001)
    y = got(filters.drc(seq(spark, x), 8000, -20, 2, makeup_gain=10))[0]
    assert np.var(y) == pytest.approx(0.5651, abs=2e-3)


def test_griffin(spark):
    power = spectra.stft(seq(spark, [1, 2, 3]), 3, 1, 8)
    y = got(filters.griffin(power, 3, 1, 8, 3, n_iter=10))[0]
    np.testing.assert_allclose(np.abs(np.round(y)), [1, 2, 3])


def test_generators(spark):
    x = lambda df: [r["x"] for r in df.orderBy("n").collect()]
    assert x(src.impulse(spark, 3)) == [1, 0, 0, 0]
    assert x(src.ramp(spark, 4)) == [0, 1, 2, 3, 4] and x(src.ramp(spark, 4, 1, -1)) == [4, 3, 2, 1]
    np.testing.assert_allclose(x(src.sin(spark, 4)), [0, 0.9511, 0.5878, -0.5878, -0.9511], atol=1e-4)
    np.testing.assert_allclose(x(src.train(spark, 5, 2.3)), [1.5166, 0, 0, 1.5166, 0, 1.5166], atol=1e-4)
    assert set(x(src.mseq(spark, 500))) == {1.0, -1.0} and abs(np.mean(x(src.mseq(spark, 2000)))) < 0.1
    noise = x(src.nrand(spark, 10_000, 1, 2, seed=3))
    assert abs(np.mean(noise) - 1) < 0.1 and abs(np.std(noise) - 2) < 0.1
    assert len(x(src.rand(spark, 9, -1, 1))) == 10


def test_wav(spark, tmp_path):
    x = np.round(np.sin(np.arange(50)) * 16384) / 32768
    (tmp_path / "a.wav").write_bytes(src.encoded(x, 8000))
    rows = src.read(spark, str(tmp_path / "*.wav"), chunk=16)
    assert rows.count() == 50 and rows.first()["rate"] == 8000
    np.testing.assert_allclose([r["x"] for r in rows.orderBy("n").collect()], x)
    src.write(rows, str(tmp_path / "out"), 8000)
    content = spark.read.parquet(str(tmp_path / "out")).first()["content"]
    np.testing.assert_allclose(src.decoded(bytes(content))[1][:, 0], x)


def test_numbered_counts_over_days(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, (id * 7) % 100) AS ts, id AS tie, double(id) AS v FROM range(100)")
    numbered = src.numbered(rows, "k", "ts", "tie", "v").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(100))
    assert [(r["x"] * 7) % 100 for r in numbered] == list(range(100))


