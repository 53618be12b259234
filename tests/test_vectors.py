"""Vector operators against documented values, inverses and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelath.functions import bases
from wavelath.functions.columns import batched, linear
from wavelath.functions.scales import get_alpha, hz_to_scale, scale_to_hz
from wavelath.operators import metrics, pointwise, prediction, spectra, transforms

R4, R14 = [0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]
C = [0.5, -0.3, 0.2, -0.1, 0.05]
SIGNAL = [0.1, 0.2, 0.3, 0.4, 0.5]


def lpc(x):
    return prediction.lpc(x, 2)


CASES = {
    "acorr": (lambda x: prediction.acorr(x, 3), R4, [30, 20, 11, 4]),
    "acorr_biased": (lambda x: prediction.acorr(x, 1, "biased"), R4, [6, 4]),
    "alaw": (lambda x: F.transform(x, lambda v: pointwise.alaw(v, 4)), R4, [0, 2.9868, 3.4934, 3.7897, 4]),
    "ialaw": (lambda x: F.transform(x, lambda v: pointwise.ialaw(pointwise.alaw(v, 4), 4)), R4, R4),
    "ulaw": (lambda x: F.transform(x, lambda v: pointwise.ulaw(v, 4)), R4, [0, 3.0084, 3.5028, 3.7934, 4]),
    "iulaw": (lambda x: F.transform(x, lambda v: pointwise.iulaw(pointwise.ulaw(v, 4), 4)), R4, R4),
    "quantize": (lambda x: F.transform(x, lambda v: pointwise.quantize(v, 4, 2).cast("double")), list(range(-4, 5)), [0, 0, 1, 1, 2, 2, 3, 3, 3]),
    "dequantize": (lambda x: F.transform(x, lambda v: pointwise.dequantize(pointwise.quantize(v, 4, 2), 4, 2)), list(range(-4, 5)), [-3, -3, -1, -1, 1, 1, 3, 3, 3]),
    "c2acr": (lambda x: prediction.c2acr(x, 3), C, [3.2404, -1.1920, 0.9037, -0.5838]),
    "c2mpir": (lambda x: prediction.c2mpir(x, 5), C, [1.6487, -0.4946, 0.4039, -0.2712, 0.1803]),
    "c2ndps": (lambda x: transforms.c2ndps(x, 4, 8), R4, [30, -21.6569, 12, -10.3431, 10]),
    "ndps2c": (lambda x: transforms.ndps2c(x, 8, 4), R4, [0, -1.7071, 0, -0.0976, 0]),
    "dct": (lambda x: transforms.dct(x, 4), R4[:4], [3, -2.2304, 0, -0.1585]),
    "dst": (lambda x: transforms.dst(x, 4), R4[:4], [2.7716, -2, 1.1481, -1]),
    "dht": (lambda x: transforms.dht(x, 4), R4[:4], [3, -1.4142, -1, -1.4142]),
    "wht": (lambda x: transforms.wht(x, 4), R4[:4], [3, -1, -2, 0]),
    "entropy": (lambda x: F.array(pointwise.entropy(x, "bit")), [0.25] * 4, [2]),
    "entropy_zero": (lambda x: F.array(pointwise.entropy(x, "nat")), [0.0, 1.0], [0]),
    "freqt": (lambda x: transforms.freqt(x, 3, 4, 0.02), R14, [1.0412, 2.1240, 3.1949, 3.8666, -0.2358]),
    "freqt_back": (lambda x: transforms.freqt(transforms.freqt(x, 3, 4, 0.02), 4, 3, -0.02), R14, R14),
    "freqt2": (lambda x: transforms.freqt2(x, 3, 4, 0.1, 0.3), [0.8, 0.6, -1.0, -0.5], [0.8388, 0.4785, -1.1090, -0.3654, 0.0682]),
    "ifreqt2": (lambda x: transforms.ifreqt2(transforms.freqt2(x, 3, 4, 0.05, 0.3), 4, 3, 0.05, 0.3), [0.8, 0.6, -1.0, -0.5], [0.8, 0.6, -1.0, -0.5]),
    "gnorm": (lambda x: pointwise.gnorm(x, 0.5), R14, [2.25, 1.3333, 2, 2.6667]),
    "ignorm": (lambda x: pointwise.ignorm(pointwise.gnorm(x, 0.5), 0.5), R14, R14),
    "gnorm_log": (lambda x: pointwise.ignorm(pointwise.gnorm(x)), R14, R14),
    "grpdelay": (lambda x: spectra.grpdelay(x, None, 8), R4[:4], [2.3333, 2.4278, 3, 3.9252, 3]),
    "hilbert": (lambda x: transforms.hilbert(x)["im"], R4[:4], [1, -1, -1, 1]),
    "is2par": (lambda x: pointwise.is2par(x), [0.1, 0.2, 0.3, 0.4], [0.1, 0.3090, 0.4540, 0.5878]),
    "par2is": (lambda x: pointwise.is2par(pointwise.par2is(x)), [0.1, 0.2, 0.3, 0.4], [0.1, 0.2, 0.3, 0.4]),
    "lar2par": (lambda x: pointwise.lar2par(x), [0.1, 0.2, 0.3, 0.4], [0.1, 0.0997, 0.1489, 0.1974]),
    "par2lar": (lambda x: pointwise.lar2par(pointwise.par2lar(x)), [0.1, 0.2, 0.3, 0.4], [0.1, 0.2, 0.3, 0.4]),
    "lpc": (lpc, SIGNAL, [0.5054, -0.8140, 0.1193]),
    "levdur": (lambda x: prediction.levdur(prediction.acorr(x, 2)), SIGNAL, [0.5054, -0.8140, 0.1193]),
    "rlevdur": (lambda x: prediction.rlevdur(lpc(x)), SIGNAL, [0.55, 0.4, 0.26]),
    "lpc2lsp": (lambda x: prediction.lpc2lsp(lpc(x)), SIGNAL, [0.5054, 0.5598, 1.6042]),
    "lpc2par": (lambda x: prediction.lpc2par(lpc(x)), SIGNAL, [0.5054, -0.7273, 0.1193]),
    "par2lpc": (lambda x: prediction.par2lpc(prediction.lpc2par(lpc(x))), SIGNAL, [0.5054, -0.8140, 0.1193]),
    "lpccheck": (lambda x: prediction.lpccheck(x), [1.0, -2.5, 2.8, -1.5, 0.4], [1, -2.4825, 2.7743, -1.4930, 0.4]),
    "lsp2lpc": (lambda x: prediction.lsp2lpc(x), R4[:4], [0, 0.8658, -0.0698, 0.0335]),
    "lsp2lpc_back": (lambda x: prediction.lpc2lsp(prediction.lsp2lpc(x, sample_rate=8000, in_format="hz"), sample_rate=8000, out_format="hz"), [1.0, 300, 900, 1500, 3000], [1, 300, 900, 1500, 3000]),
    "lsp2sp": (lambda x: prediction.lsp2sp(prediction.lpc2lsp(lpc(x)), 8), SIGNAL, [2.7407, 0.6577, 0.1776, 0.0861, 0.0683]),
    "lspcheck": (lambda x: prediction.lspcheck(x, 0.01, 10), [1.0, 0.0, 0.0, 0.5 * np.pi, np.pi], [1, 0.0063, 0.0126, 1.5708, 3.1353]),
    "mc2b": (lambda x: transforms.mc2b(x, 4, 0.3), R4, [-0.1686, 0.5620, 1.46, 1.8, 4]),
    "b2mc": (lambda x: pointwise.b2mc(transforms.mc2b(x, 4, 0.3), 0.3), R4, R4),
    "mcep": (lambda x: prediction.mcep(x, 8, 3, 0.1, 1), [1.2, 0.9, 0.2, 0.1, 0.3], [-0.4989, 0.5941, 0.1558, -0.2130]),
    "mcpf": (lambda x: prediction.mcpf(x, 3, 0.1, 0.2), [-0.4989, 0.5941, 0.1558, -0.2130], [-0.5097, 0.5941, 0.1869, -0.2556]),
    "mgc2mgc": (lambda x: prediction.mgc2mgc(x, 4, 0.1), R4[:4], [-0.0830, 0.6831, 1.1464, 3.1334, 0.9063]),
    "mlsacheck": (lambda x: prediction.mlsacheck(x, 0.1), [1.8963, 7.6629, 4.4804, 8.0669, -1.2768], [1.3336, 1.7537, 1.0254, 1.8462, -0.2922]),
    "mpir2c": (lambda x: prediction.mpir2c(x, 3), [4.0, 3, 2, 1, 0], [1.3863, 0.75, 0.2188, 0.0156]),
    "norm0": (lambda x: pointwise.norm0(x), [4.0, 3, 2, 1], [0.25, 0.75, 0.5, 0.25]),
    "phase": (lambda x: spectra.phase(x, None, 8), R4[:4], [0, -0.5907, 0.75, -0.1687, 1]),
    "pnorm": (lambda x: prediction.pnorm(x, 3, 0.1), R14, [16.5884, -7.2942, 2, 3, 4]),
    "ipnorm": (lambda x: pointwise.ipnorm(prediction.pnorm(x, 3, 0.1)), R14, R14),
    "pol_root": (lambda x: prediction.pol_root(x), [3.0, 4, -1], [1, -6, 5, 12]),
    "root_pol": (lambda x: prediction.root_pol(x), [3.0, 4, 5], [-0.6667, -0.6667]),
    "root_pol_imaginary": (lambda x: F.transform(prediction.root_pol(x, "imaginary"), F.abs), [3.0, 4, 5], [1.1055, 1.1055]),
    "spec": (lambda x: spectra.spec(x, None, 8), [1.0, 2, 3], [36, 25.3137, 8, 2.6863, 4]),
    "window": (lambda x: transforms.window(x, 5, 7, "hamming", "none"), [1.0] * 5, [0.08, 0.54, 1, 0.54, 0.08, 0, 0]),
    "fftr_back": (lambda x: transforms.ifftr(transforms.fftr(x, 8, "real"), transforms.fftr(x, 8, "imaginary"), 8, 4), R14, R14),
}


@pytest.mark.parametrize("name", CASES)
def test_documented_values(spark, name):
    op, given, expected = CASES[name]
    # an empty and a null vector stand beside it: null stays null
    df = spark.createDataFrame([(0, [float(v) for v in given]), (1, None)], "id int, x array<double>")
    if name in ("quantize", "dequantize", "alaw", "ialaw", "ulaw", "iulaw"):
        df = df.filter("id = 0")
    got = {r[0]: r[1] for r in df.select("id", op(F.col("x")).alias("y")).collect()}
    np.testing.assert_allclose(got[0], expected, rtol=1e-3, atol=6e-4)
    assert got.get(1) is None or got[1] == [None]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_orthonormal_transforms(kind):
    for make in (bases.dct_matrix, bases.dst_matrix, bases.dht_matrix):
        np.testing.assert_allclose(make(8, bases.INVERSE[kind]) @ make(8, kind), np.eye(8), atol=1e-12)


@pytest.mark.parametrize("kind", ["sequency", "natural", "dyadic"])
def test_walsh_orders(kind):
    m = bases.wht_matrix(16, kind)
    np.testing.assert_allclose(m @ m.T, np.eye(16), atol=1e-12)
    if kind == "sequency":
        assert [(np.diff(np.sign(r)) != 0).sum() for r in m] == list(range(16))


@pytest.mark.parametrize("name", bases.WINDOWS)
def test_windows(name):
    w = bases.window_values(16, name)
    np.testing.assert_allclose(w, w[::-1], atol=1e-12)
    assert np.isclose(np.sum(bases.window_values(16, name, "power") ** 2), 1)
    assert np.isclose(np.sum(bases.window_values(16, name, "magnitude")), 1)


def test_power_complementary_windows():
    for name in ("sine", "vorbis", "kbd"):
        w = bases.window_values(16, name) ** 2
        np.testing.assert_allclose(w[:8] + w[8:], 1, atol=1e-12)


def test_scales():
    f = np.array([100.0, 1000.0, 3900.0])
    for scale in ("htk", "mel", "inverted-mel", "bark", "linear"):
        np.testing.assert_allclose(scale_to_hz(hz_to_scale(f, scale), scale), f)
    assert get_alpha(16000) == 0.42
    assert abs(get_alpha(16000, "auto") - 0.42) < 0.05


def test_ragged_and_null_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, 2.0, 3.0]), (3, [None, 1.0])], "id int, x array<double>")
    got = {r[0]: r[1] for r in df.select("id", batched(lambda v: v * 2, "x").alias("y")).collect()}
    assert got[0] == [2.0, 4.0] and got[1] is None and got[2] == [2.0, 4.0, 6.0] and np.isnan(got[3][0])
    assert df.limit(0).select(batched(lambda v: v, "x")).collect() == []


def test_wrong_length_is_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "id int, x array<double>")
    with pytest.raises(Exception, match="expected vectors of 3"):
        df.select(linear(np.eye(3))("x")).collect()


def test_newton_cepstra_reach_the_optimum(spark):
    """More steps change nothing, and gamma -1 without warping is linear prediction."""
    rng = np.random.default_rng(0)
    signal = rng.normal(size=64)
    power = (np.abs(np.fft.rfft(np.convolve(signal, [1, 0.7, 0.3])[:64])) ** 2 + 1).tolist()
    df = spark.createDataFrame([(power,)], "x array<double>")
    for op in (
        lambda n: prediction.mcep("x", 64, 8, 0.2, n), lambda n: prediction.mgcep("x", 64, 8, 0.2, -0.5, n_iter=n),
        lambda n: prediction.smcep("x", 64, 8, 0.1, 0.2, n),
    ):
        a, b = df.select(op(12), op(13)).first()
        np.testing.assert_allclose(a, b, atol=1e-8)
    ar, mgc = df.select(
        prediction.levdur(batched(lambda p: np.fft.irfft(p)[:, :9], "x")),
        prediction.mgc2mgc(prediction.mgcep("x", 64, 8, 0, -1, n_iter=8), 8, in_gamma=-1, out_gamma=-1, out_norm=True),
    ).first()
    np.testing.assert_allclose(-np.array(mgc[1:]), ar[1:], atol=1e-6)


def test_mlpg_inverts_delta():
    seed = [[-0.5, 0], [0, 0, 0.5]]
    rows = bases.delta_windows(seed)
    x = np.arange(1.0, 9).reshape(4, 2)
    padded = np.concatenate([x[:1], x, x[-1:]])
    features = np.stack([np.concatenate([(rows[h][:, None] * padded[t : t + 3]).sum(0) for h in range(3)]) for t in range(4)])
    solve = transforms.mlpg_matrix(4, seed)
    np.testing.assert_allclose(np.einsum("nd,tn->td", features.reshape(12, 2), solve), x, atol=1e-9)


def test_dtw(spark):
    df = spark.createDataFrame([([1.0, 3.0, 6.0, 9.0], [2.0, 3.0, 8.0, 8.0])], "x array<double>, y array<double>")
    distance, path = df.select(metrics.dtw("x", "y", 1, p=1), metrics.dtw_path("x", "y", 1, p=1)).first()
    assert abs(distance - 0.8749) < 1e-3
    assert path[:10] == [0, 0, 1, 1, 2, 2, 3, 2, 3, 3] and path[10] == -1


@pytest.mark.parametrize("p", range(7))
def test_dtw_constraints_on_equal_sequences(spark, p):
    df = spark.createDataFrame([([1.0, 3.0, 6.0, 9.0],)], "x array<double>")
    got = df.select(metrics.dtw("x", "x", 1, p=p)).first()[0]
    # equal sequences cost nothing where a step along both is allowed
    assert got == pytest.approx(0, abs=1e-3) if p else got > 0


def test_scores(spark):
    pairs = spark.createDataFrame([(0, [0.1, -0.2, 0.3, -0.4, 0.5], [-0.4, 0.9, 1.1, 3.2, -0.3])], "id int, x array<double>, y array<double>")
    assert metrics.rmse(pairs).first()[0] == pytest.approx(1.7720, abs=1e-4)
    c = spark.createDataFrame([(0, [0.4296, 1.6517], [1.6441, -0.6962]), (1, [-1.0464, -0.6088], [0.9344, 0.3965])], "id int, x array<double>, y array<double>")
    assert {r["id"]: round(r["cdist"], 4) for r in metrics.cdist(c, reduction="none").collect()} == {0: 2.3479, 1: 1.0053}
    s = [0.1, -0.2, 0.3, -0.4, 0.5]
    noisy = spark.createDataFrame([(0, n, v, 1.1 * v) for n, v in enumerate(s)], "seq int, n long, s double, sn double")
    assert metrics.snr(noisy, full=True).first()[0] == pytest.approx(20, abs=1e-4)
    f0 = spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(zip([100, 200, 300, 0, 400], [110, 180, 0, 290, 410]))], "seq int, t long, x double, y double")
    assert metrics.f0eval(f0).first()[0] == pytest.approx(144.1353, abs=1e-3)
    assert metrics.f0eval(f0, out_format="vuv-error-percent").first()[0] == pytest.approx(40)
