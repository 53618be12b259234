"""Queries of vector operators over embeddings, each with the SQL of its definition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import numbers
from ..operators import learners, metrics, pointwise, prediction, spectra, transforms
from . import fixtures as fx
from .fixtures import PI, grid, linear_sql, matrix_sql, vectors_sql, y

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, op, sql: str | None = None, count: int = 64, value=None, digits: int = 6) -> None:
    """A query (id, k, y): op of the first count numbers of each vector, changed by value(x, n) before."""

    def run(spark, sf_dir):
        df = fx.first(fx.v(spark, sf_dir), count)
        df = df if value is None else df.withColumn("x", F.transform("x", value))
        return fx.long(df.select("id", op(F.col("x")).alias("out")), ["id"], "out", digits)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def listed(expression: str, count: int, value: str = "x", outputs: int | None = None, digits: int = 6) -> str:
    """SQL of a formula over lists: l is the vector (1-based), k the output (0-based)."""
    return f"WITH {vectors_sql(count, value)}, l AS (SELECT id, list(x ORDER BY n) AS l FROM v GROUP BY id) SELECT id, k, {y(expression, digits)} FROM l, {grid('k', outputs or count)} g"


# --- constant matrices

N = 64
half_root = "sqrt(2.0 / 64)"
register("dct", lambda x: transforms.dct(x, N), linear_sql(f"cos({PI} / 64 * k * (n + 0.5)) * {half_root} * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END", N))
register("idct", lambda x: transforms.idct(x, N), linear_sql(f"cos({PI} / 64 * (k + 0.5) * n) * {half_root} * CASE WHEN n = 0 THEN sqrt(0.5) ELSE 1 END", N))
register("dst", lambda x: transforms.dst(x, N), linear_sql(f"sin({PI} / 64 * (k + 1) * (n + 0.5)) * {half_root} * CASE WHEN k = 63 THEN sqrt(0.5) ELSE 1 END", N))
register("idst", lambda x: transforms.idst(x, N), linear_sql(f"sin({PI} / 64 * (k + 0.5) * (n + 1)) * {half_root} * CASE WHEN n = 63 THEN sqrt(0.5) ELSE 1 END", N))
register("dht", lambda x: transforms.dht(x, N), linear_sql(f"(cos(2 * {PI} / 64 * k * (n + 0.5)) + sin(2 * {PI} / 64 * k * (n + 0.5))) / 8", N))
register("idht", lambda x: transforms.idht(x, N), linear_sql(f"(cos(2 * {PI} / 64 * (k + 0.5) * n) + sin(2 * {PI} / 64 * (k + 0.5) * n)) / 8", N))
register("wht", lambda x: transforms.wht(x, N), linear_sql("CASE WHEN bit_count(k & n) % 2 = 1 THEN -1 ELSE 1 END / 8.0", N))
register("iwht", lambda x: transforms.iwht(transforms.wht(x, N), N), linear_sql("CASE WHEN k = n THEN 1 ELSE 0 END", N))
register("fftr", lambda x: transforms.fftr(x, N, "real"), linear_sql(f"cos(2 * {PI} * k * n / 64)", 33))
register("fftr_imaginary", lambda x: transforms.fftr(x, N, "imaginary"), linear_sql(f"-sin(2 * {PI} * k * n / 64)", 33))
register("ifftr", lambda x: transforms.ifftr(transforms.fftr(x, N, "real"), transforms.fftr(x, N, "imaginary"), N), linear_sql("CASE WHEN k = n THEN 1 ELSE 0 END", N))
register("hilbert", lambda x: transforms.hilbert(x)["im"], linear_sql(f"CASE WHEN (k - n) % 2 = 0 THEN 0 ELSE 2.0 / 64 / tan({PI} * (k - n) / 64) END", N))
register("window", lambda x: transforms.window(x, N, 80), (
    f"WITH {vectors_sql()}, b AS (SELECT n, 0.42 - 0.5 * cos(2 * {PI} * n / 63) + 0.08 * cos(4 * {PI} * n / 63) AS b FROM {grid('n', 64)} g), z AS (SELECT sqrt(sum(b * b)) AS z FROM b) "
    f"SELECT i.id, g.k, {y('coalesce(v.x * b.b / z.z, 0)')} FROM (SELECT DISTINCT id FROM v) i CROSS JOIN {grid('k', 80)} g CROSS JOIN z LEFT JOIN v ON v.id = i.id AND v.n = g.k LEFT JOIN b ON b.n = g.k"
))
register("freqt", lambda x: transforms.freqt(x, 9, 14, 0.3), matrix_sql(bases.freqt_matrix(9, 14, 0.3)), 10)
WARP2 = "o + atan2(0.1 * sin(o - 0.2 * pi()), 1 - 0.1 * cos(o - 0.2 * pi())) + atan2(0.1 * sin(o + 0.2 * pi()), 1 - 0.1 * cos(o + 0.2 * pi()))"
SLOPE2 = "1 + 0.1 * (cos(o - 0.2 * pi()) - 0.1) / (1.01 - 0.2 * cos(o - 0.2 * pi())) + 0.1 * (cos(o + 0.2 * pi()) - 0.1) / (1.01 - 0.2 * cos(o + 0.2 * pi()))"


def warp_sql(kernel: str, outputs: int) -> str:
    return (
        f"WITH {vectors_sql(10)}, o AS (SELECT 2 * pi() * i / 512 AS o FROM {grid('i', 512)} g), p AS (SELECT o, {WARP2} AS p, {SLOPE2} AS d FROM o), "
        f"m AS (SELECT k, n, sum({kernel}) / 512 * CASE WHEN k = 0 THEN 1 ELSE 2 END AS a FROM p, {grid('k', outputs)} a, {grid('n', 10)} b GROUP BY k, n) "
        f"SELECT id, k, {y('sum(x * a)')} FROM v JOIN m USING (n) GROUP BY id, k"
    )


register("freqt2", lambda x: transforms.freqt2(x, 9, 14, 0.1, 0.2), warp_sql("cos(k * p) * d * cos(n * o)", 15), 10)
register("ifreqt2", lambda x: transforms.ifreqt2(x, 9, 14, 0.1, 0.2), warp_sql("cos(n * p) * cos(k * o)", 15), 10)
register("mc2b", lambda x: transforms.mc2b(x, 9, 0.35), linear_sql("CASE WHEN n >= k THEN pow(-0.35, n - k) ELSE 0 END", 10, 10), 10)
register("b2mc", lambda x: pointwise.b2mc(x, 0.35), linear_sql("CASE WHEN n = k THEN 1 WHEN n = k + 1 THEN 0.35 ELSE 0 END", 10, 10), 10)
register("csm2acr", pointwise.csm2acr, listed("list_sum(list_transform(range(1, 6), lambda i: l[i + 5] * cos(l[i] * k)))", 10), 10)
register("c2ndps", lambda x: transforms.c2ndps(x, 9, 32), linear_sql(f"n * cos(2 * {PI} * k * n / 32)", 17, 10), 10)
register("ndps2c", lambda x: transforms.ndps2c(x, 32, 9), linear_sql(f"CASE WHEN k = 0 THEN 0 ELSE CASE WHEN n IN (0, 16) THEN 1 ELSE 2 END * cos(2 * {PI} * k * n / 32) / (16 * k) END", 10, 17), 17)
register("mlpg", lambda x: transforms.mlpg(x, 21), matrix_sql(transforms.mlpg_matrix(21)), 63)

# --- pointwise on coefficient vectors

gain_first = lambda v, n: F.when(n == 0, 1 + F.abs(v)).otherwise(v)
GAIN = "CASE WHEN n = 0 THEN 1 + abs(x) ELSE x END"
register("gnorm", lambda x: pointwise.gnorm(x, -0.5), listed("CASE WHEN k = 0 THEN pow(1 - 0.5 * l[1], -2) ELSE l[k + 1] / (1 - 0.5 * l[1]) END", 10), 10)
register("ignorm", lambda x: pointwise.ignorm(x, -0.5), listed("CASE WHEN k = 0 THEN (pow(l[1], -0.5) - 1) / -0.5 ELSE l[k + 1] * pow(l[1], -0.5) END", 10, GAIN), 10, gain_first)
register("norm0", pointwise.norm0, listed("CASE WHEN k = 0 THEN 1 / l[1] ELSE l[k + 1] / l[1] END", 10, GAIN), 10, gain_first)
register("par2is", pointwise.par2is, listed(f"CASE WHEN k = 0 THEN l[1] ELSE asin(greatest(-1 + 1e-6, least(1 - 1e-6, l[k + 1]))) * 2 / {PI} END", 10, GAIN), 10, gain_first)
register("is2par", pointwise.is2par, listed(f"CASE WHEN k = 0 THEN l[1] ELSE sin(l[k + 1] * {PI} / 2) END", 10, GAIN), 10, gain_first)
register("par2lar", pointwise.par2lar, listed("CASE WHEN k = 0 THEN l[1] ELSE ln((1 + l[k + 1]) / (1 - l[k + 1])) END", 10, GAIN), 10, gain_first)
register("lar2par", pointwise.lar2par, listed("CASE WHEN k = 0 THEN l[1] ELSE (exp(l[k + 1]) - 1) / (exp(l[k + 1]) + 1) END", 10, GAIN), 10, gain_first)
register("ipnorm", pointwise.ipnorm, listed("CASE WHEN k = 0 THEN l[1] / 2 + l[2] ELSE l[k + 2] END", 10, outputs=9), 10)


def entropy(spark, sf_dir):
    shares = fx.v(spark, sf_dir).withColumn("x", F.transform("x", F.abs)).withColumn("x", F.transform("x", lambda a: a / F.aggregate("x", F.lit(0.0), lambda s, b: s + b)))
    return shares.select("id", (F.round(pointwise.entropy("x", "bit"), 6) + 0.0).alias("y"))


QUERIES["entropy"] = entropy
ORACLES["entropy"] = f"WITH {vectors_sql(64, 'abs(x)')}, p AS (SELECT id, x / sum(x) OVER (PARTITION BY id) AS p FROM v) SELECT id, {y('sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END)')} FROM p GROUP BY id"

# --- linear prediction: orders that SQL can solve in closed form

spectrum = lambda v, n: v * v + 0.01
SPECTRUM = "x * x + 0.01"
acr = "SELECT id, list(r ORDER BY k) AS l FROM (SELECT a.id, k, sum(a.x * b.x) AS r FROM v a, {g} g, v b WHERE b.id = a.id AND b.n = a.n + k GROUP BY a.id, k) GROUP BY id"
LAG2 = acr.format(g=grid("k", 3))
PREDICT = "CASE k WHEN 1 THEN (l[2] * l[3] - l[1] * l[2]) / (l[1] * l[1] - l[2] * l[2]) WHEN 2 THEN (l[2] * l[2] - l[1] * l[3]) / (l[1] * l[1] - l[2] * l[2]) END"
SOLVED = f"a AS (SELECT id, k, {PREDICT} AS a FROM l, {grid('k', 3)} g WHERE k > 0), b AS (SELECT id, max(CASE WHEN k = 1 THEN a END) AS a1, max(CASE WHEN k = 2 THEN a END) AS a2 FROM a GROUP BY id)"
register("acorr", lambda x: prediction.acorr(x, 8, "unbiased"), (
    f"WITH {vectors_sql()} SELECT a.id, k, {y('sum(a.x * b.x) / (64 - k)')} FROM v a, {grid('k', 9)} g, v b WHERE b.id = a.id AND b.n = a.n + k GROUP BY a.id, k"
))
GAIN2 = "sqrt(l[1] + l[2] * a1 + l[3] * a2)"
LPC = f"WITH {vectors_sql()}, l AS ({LAG2}), {SOLVED} SELECT id, k, {y(f'CASE k WHEN 0 THEN {GAIN2} WHEN 1 THEN a1 ELSE a2 END')} FROM l JOIN b USING (id), {grid('k', 3)} g"
register("lpc", lambda x: prediction.lpc(x, 2), LPC)
register("levdur", lambda x: prediction.levdur(prediction.acorr(x, 2)), LPC)


def lpc_of(x):
    return prediction.lpc(x, 2)


def lpc_sql(expression: str, outputs: int = 3, digits: int = 6) -> str:
    """SQL of a formula of the gain and the coefficients a1 and a2 of a predictor."""
    return f"WITH {vectors_sql()}, l AS ({LAG2}), {SOLVED}, p AS (SELECT id, {GAIN2} AS gain, a1, a2 FROM l JOIN b USING (id)) SELECT id, k, {y(expression, digits)} FROM p, {grid('k', outputs)} g"


register("lpc2par", lambda x: prediction.lpc2par(lpc_of(x)), lpc_sql("CASE g.k WHEN 0 THEN p.gain WHEN 1 THEN a1 / (1 + a2) ELSE a2 END"))
register("par2lpc", lambda x: prediction.par2lpc(prediction.lpc2par(lpc_of(x))), lpc_sql("CASE g.k WHEN 0 THEN p.gain WHEN 1 THEN a1 ELSE a2 END"))
register("lpccheck", lambda x: prediction.lpccheck(lpc_of(x)), lpc_sql("CASE g.k WHEN 0 THEN p.gain WHEN 1 THEN a1 ELSE a2 END"))
LSP = "CASE g.k WHEN 0 THEN p.gain WHEN 1 THEN least(acos((1 - a1 - a2) / 2), acos((a2 - a1 - 1) / 2)) ELSE greatest(acos((1 - a1 - a2) / 2), acos((a2 - a1 - 1) / 2)) END"
register("lpc2lsp", lambda x: prediction.lpc2lsp(lpc_of(x)), lpc_sql(LSP))
register("lsp2lpc", lambda x: prediction.lsp2lpc(prediction.lpc2lsp(lpc_of(x))), lpc_sql("CASE g.k WHEN 0 THEN p.gain WHEN 1 THEN a1 ELSE a2 END"))
register("lsp2sp", lambda x: prediction.lsp2sp(prediction.lpc2lsp(lpc_of(x)), 32), lpc_sql(f"p.gain * p.gain / (pow(1 + a1 * cos({PI} * g.k / 16) + a2 * cos({PI} * g.k / 8), 2) + pow(a1 * sin({PI} * g.k / 16) + a2 * sin({PI} * g.k / 8), 2))", 17))
register("lspcheck", lambda x: prediction.lspcheck(x, 0.3), listed(
    f"CASE k WHEN 0 THEN l[1] WHEN 1 THEN least({PI} * 0.9, greatest({PI} * 0.1, l[2] - greatest({PI} * 0.1 - (l[3] - l[2]), 0) / 2)) ELSE least({PI} * 0.9, greatest({PI} * 0.1, l[3] + greatest({PI} * 0.1 - (l[3] - l[2]), 0) / 2)) END", 3, "1.5 + n * 0.2 + x"
), 3, lambda v, n: 1.5 + n * 0.2 + v)
register("rlevdur", lambda x: prediction.rlevdur(lpc_of(x), 33), lpc_sql(f"list_sum(list_transform(range(64), lambda i: p.gain * p.gain * cos(2 * {PI} * i * g.k / 64) / (pow(1 + a1 * cos(2 * {PI} * i / 64) + a2 * cos(4 * {PI} * i / 64), 2) + pow(a1 * sin(2 * {PI} * i / 64) + a2 * sin(4 * {PI} * i / 64), 2)))) / 64"))
register("root_pol", prediction.root_pol, listed(
    "CASE WHEN l[2] * l[2] < 4 * l[1] * l[3] THEN -l[2] / (2 * l[1]) ELSE (-l[2] + CASE WHEN (k = 0) = (l[2] < 0) THEN 1 ELSE -1 END * sqrt(l[2] * l[2] - 4 * l[1] * l[3])) / (2 * l[1]) END", 3, GAIN, outputs=2
), 3, gain_first)
register("pol_root", prediction.pol_root, listed("CASE k WHEN 0 THEN 1 WHEN 1 THEN -(l[1] + l[2] + l[3]) WHEN 2 THEN l[1] * l[2] + l[1] * l[3] + l[2] * l[3] ELSE -l[1] * l[2] * l[3] END", 3, outputs=4), 3)


def acr2csm(spark, sf_dir):
    """The autocorrelation, put together again from its sinusoids."""
    models = fx.v(spark, sf_dir).select("id", prediction.acr2csm(prediction.acorr("x", 5), 5).alias("x"))
    return fx.long(models.select("id", pointwise.csm2acr("x").alias("out")), ["id"], "out")


QUERIES["acr2csm"] = acr2csm
ORACLES["acr2csm"] = f"WITH {vectors_sql()} SELECT a.id, k, {y('sum(a.x * b.x)')} FROM v a, {grid('k', 6)} g, v b WHERE b.id = a.id AND b.n = a.n + k GROUP BY a.id, k"

# --- cepstra on a circle of 64 points

CIRCLE = f"c AS (SELECT id, i, sum(x * cos(2 * {PI} * i * n / 64)) AS re, -sum(x * sin(2 * {PI} * i * n / 64)) AS im FROM v, {grid('i', 64)} g GROUP BY id, i)"


def circle_sql(expression: str, outputs: int, count: int = 10, value: str = "x", scale: str = "1") -> str:
    """Sums over the circle of a formula of the spectrum (re, im), its place i and the output k."""
    return f"WITH {vectors_sql(count, value)}, {CIRCLE} SELECT id, k, {y(f'sum({expression}) / 64 * ({scale})')} FROM c, {grid('k', outputs)} g GROUP BY id, k"


register("c2acr", lambda x: prediction.c2acr(x, 5, 64), circle_sql(f"exp(2 * re) * cos(2 * {PI} * i * k / 64)", 6), 10)
register("c2mpir", lambda x: prediction.c2mpir(x, 12, 64), circle_sql(f"exp(re) * cos(im + 2 * {PI} * i * k / 64)", 12), 10)
register("mpir2c", lambda x: prediction.mpir2c(x, 9, 64), circle_sql(f"0.5 * ln(re * re + im * im) * cos(2 * {PI} * i * k / 64)", 10, 10, "CASE WHEN n = 0 THEN 5 ELSE x END", "CASE WHEN k = 0 THEN 1 ELSE 2 END"), 10, lambda v, n: F.when(n == 0, 5.0).otherwise(v))
HALF = f"CASE WHEN n IN (0, 32) THEN 1 ELSE 2 END * cos(2 * {PI} * k * n / 64) / 64"
register("fftcep", lambda x: prediction.fftcep(x, 64, 12), linear_sql(f"{HALF} * CASE WHEN k = 0 THEN 0.5 ELSE 1 END", 13, 33, f"ln({SPECTRUM})"), 33, spectrum)
CEPSTRUM = np.cos(2 * np.pi * np.outer(np.arange(33), np.arange(33)) / 64) / 64 * np.where(np.isin(np.arange(33), (0, 32)), 1, 2) * np.where(np.isin(np.arange(33), (0, 32)), 0.5, 1)[:, None]
register("mcep", lambda x: prediction.mcep(x, 64, 12, 0.3), matrix_sql(bases.freqt_matrix(32, 12, 0.3) @ CEPSTRUM, f"ln({SPECTRUM})"), 33, spectrum)
register("smcep", lambda x: prediction.smcep(x, 64, 12, 0.1, 0.2), matrix_sql(bases.freqt2_matrix(32, 12, 0.1, 0.2, 256) @ CEPSTRUM, f"ln({SPECTRUM})"), 33, spectrum)
register("mcep_newton", lambda x: prediction.mcep(x, 64, 12, 0.3, 5), None, 33, spectrum)
register("mgcep", lambda x: prediction.mgcep(x, 64, 8, 0.1, -0.5, n_iter=5), None, 33, spectrum)
register("mgc2mgc", lambda x: prediction.mgc2mgc(x, 14, 0.1, 0.3), matrix_sql(bases.freqt_matrix(9, 14, 0.2 / 0.97)), 10)
register("mgc2mgc_gamma", lambda x: prediction.mgc2mgc(prediction.mgc2mgc(x, 30, out_gamma=-0.5), 9, in_gamma=-0.5), linear_sql("CASE WHEN k = n THEN 1 ELSE 0 END", 10, 10), 10, lambda v, n: v * 0.5 ** n)
ORACLES["mgc2mgc_gamma"] = linear_sql("CASE WHEN k = n THEN 1 ELSE 0 END", 10, 10, "x * pow(0.5, n)")
register("mgc2sp", lambda x: prediction.mgc2sp(x, 64), f"WITH {vectors_sql(10)}, {CIRCLE} SELECT id, i AS k, {y('exp(2 * re)')} FROM c WHERE i <= 32", 10)
register("pnorm", lambda x: prediction.pnorm(x, 9, 0, 64), (
    f"WITH {vectors_sql(10)}, {CIRCLE}, p AS (SELECT id, ln(sum(exp(2 * re)) / 64) AS p FROM c GROUP BY id), l AS (SELECT id, list(x ORDER BY n) AS l FROM v GROUP BY id) "
    f"SELECT id, k, {y('CASE k WHEN 0 THEN p WHEN 1 THEN l[1] - p / 2 ELSE l[k] END')} FROM l JOIN p USING (id), {grid('k', 11)} g"
), 10)
register("mcpf", lambda x: prediction.mcpf(x, 9, 0, 0.3, 2, 64), (
    f"WITH {vectors_sql(10)}, {CIRCLE}, d AS (SELECT id, i, sum(x * CASE WHEN n < 2 THEN 1 ELSE 1.3 END * cos(2 * {PI} * i * n / 64)) AS re FROM v, {grid('i', 64)} g GROUP BY id, i), "
    "p AS (SELECT id, ln(sum(exp(2 * re))) AS p FROM c GROUP BY id), q AS (SELECT id, ln(sum(exp(2 * re))) AS q FROM d GROUP BY id) "
    f"SELECT id, n AS k, {y('x * CASE WHEN n < 2 THEN 1 ELSE 1.3 END + CASE WHEN n = 0 THEN (p - q) / 2 ELSE 0 END')} FROM v JOIN p USING (id) JOIN q USING (id)"
), 10)
register("mlsacheck", lambda x: prediction.mlsacheck(x, 0.1, threshold=0.05), (
    f"WITH {vectors_sql(10)}, t AS (SELECT id, sum(x * pow(-0.1, n)) AS g, sum(x) AS t FROM v GROUP BY id), z AS (SELECT id, g, least(1, 0.05 / greatest(t - g, 1e-16)) AS z FROM t) "
    f"SELECT id, n AS k, {y('CASE WHEN n = 0 THEN (x - g) * z + g ELSE x * z END')} FROM v JOIN z USING (id)"
), 10)

# --- spectra and filter banks

register("spec", lambda x: spectra.spec(x, None, 64), f"WITH {vectors_sql(10)}, {CIRCLE} SELECT id, i AS k, {y('re * re + im * im')} FROM c WHERE i <= 32", 10)
register("phase", lambda x: F.slice(spectra.phase(x, None, 64), 1, 32), f"WITH {vectors_sql(10, GAIN)}, {CIRCLE} SELECT id, i AS k, {y(f'CASE WHEN i = 0 THEN CASE WHEN re < 0 THEN 1 ELSE 0 END ELSE atan2(im, re) / {PI} END')} FROM c WHERE i < 32", 10, gain_first)
RAMPED = f"d AS (SELECT id, i, sum(x * n * cos(2 * {PI} * i * n / 64)) AS dre, -sum(x * n * sin(2 * {PI} * i * n / 64)) AS dim FROM v, {grid('i', 64)} g GROUP BY id, i)"
register("grpdelay", lambda x: spectra.grpdelay(x, None, 64), f"WITH {vectors_sql(10, 'CASE WHEN n = 0 THEN 5 ELSE x END')}, {CIRCLE}, {RAMPED} SELECT id, i AS k, {y('(re * dre + im * dim) / (re * re + im * im)')} FROM c JOIN d USING (id, i) WHERE i <= 32", 10, lambda v, n: F.when(n == 0, 5.0).otherwise(v))
BANK = spectra.triangles(64, 8, 8000.0)


def bank_sql(channel: str, outputs: int = 8) -> str:
    return f"WITH {vectors_sql(33, SPECTRUM)}, {fx.matrix_cte(BANK.T)}, b AS (SELECT id, k, ln(greatest(sum(sqrt(x) * a), 1e-5)) AS b FROM v JOIN m USING (n) GROUP BY id, k) {channel}"


register("fbank", lambda x: spectra.fbank(x, 64, 8, 8000.0), bank_sql(f"SELECT id, k, {y('b')} FROM b"), 33, spectrum)
register("mfcc", lambda x: spectra.mfcc(x, 64, 5, 8, 8000.0, 22), bank_sql(
    f"SELECT id, q AS k, {y(f'sum(b * cos({PI} / 8 * (q + 1) * (k + 0.5))) * 0.5 * (1 + 11 * sin({PI} * (q + 1) / 22))')} FROM b, {grid('q', 5)} g GROUP BY id, q"
), 33, spectrum)
register("ifbank", lambda x: spectra.ifbank(x, 8, 64, 8000.0, use_power=True), matrix_sql(np.linalg.pinv(BANK).T, "exp(x)"), 8)
MEL = "1127 * ln(1 + 4000 / 700.0) * (k + 1) / 9 / 1127"
STEP = (
    "k{0} AS (SELECT id, r, list_transform(range({0} + 1), lambda j: CASE WHEN j = 0 THEN 1.0 WHEN j = {0} THEN k ELSE a[j + 1] + k * a[{0} - j + 1] END) AS a, e * (1 - k * k) AS e "
    "FROM (SELECT id, r, a, e, -list_sum(list_transform(range({0}), lambda j: a[j + 1] * r[{0} - j + 1])) / e AS k FROM k{1}) z)"
)
register("plp", lambda x: spectra.plp(x, 64, 4, 8, 8000.0), (
    f"WITH {vectors_sql(33, SPECTRUM)}, {fx.matrix_cte(BANK.T)}, b AS (SELECT id, k, greatest(sum(x * a), 1e-5) AS b FROM v JOIN m USING (n) GROUP BY id, k), "
    f"f AS (SELECT k, pow(700 * (exp({MEL}) - 1), 2) AS f FROM {grid('k', 8)} g), "
    "c AS (SELECT id, k, pow(b * pow(f / (f + 1.6e5), 2) * (f + 1.44e6) / (f + 9.61e6), 0.33) AS c FROM b JOIN f USING (k)), l AS (SELECT id, list(c ORDER BY k) AS l FROM c GROUP BY id), "
    "s AS (SELECT id, list_concat([l[1]], l, [l[8]]) AS s FROM l), "
    "r AS (SELECT id, list_transform(range(5), lambda q: (s[1] + s[10] * pow(-1, q) + 2 * list_sum(list_transform(range(1, 9), lambda i: s[i + 1] * cos(2 * pi() * i * q / 18)))) / 18) AS r FROM s), "
    f"k0 AS (SELECT id, r, [1.0] AS a, r[1] AS e FROM r), {', '.join(STEP.format(k, k - 1) for k in range(1, 5))}, "
    "p AS (SELECT id, i, 0.5 * ln(pow(1 + list_sum(list_transform(range(1, 5), lambda j: a[j + 1] * cos(2 * pi() * i * j / 512))), 2) + pow(list_sum(list_transform(range(1, 5), lambda j: a[j + 1] * sin(2 * pi() * i * j / 512))), 2)) AS p "
    f"FROM k4, {grid('i', 512)} g) "
    f"SELECT id, q AS k, {y('-sum(p * cos(2 * pi() * i * (q + 1) / 512)) / 256 * (1 + 0.5 * sin(pi() * (q + 1)))')} FROM p, {grid('q', 4)} g GROUP BY id, q"
), 33, spectrum)
CHROMA = spectra.chroma_weights(64, 12, 8000.0)
register("chroma", lambda x: spectra.chroma(x, 64, 12, 8000.0), (
    f"WITH {vectors_sql(33, SPECTRUM)}, {fx.matrix_cte(CHROMA)}, c AS (SELECT id, k, sum(x * a) AS c FROM v JOIN m USING (n) GROUP BY id, k) SELECT id, k, {y('c / max(abs(c)) OVER (PARTITION BY id)')} FROM c"
), 33, spectrum)
LOW = "12 * log2(8000 / (440.0 * {0})) + 69"
register("yingram", lambda x: spectra.yingram(x, 8000.0, 10, n_bin=4), (
    f"WITH {vectors_sql()}, u AS (SELECT id, list(x ORDER BY n) AS l FROM v GROUP BY id), "
    "d AS (SELECT id, t, list_dot_product(l[1:64 - t], l[1:64 - t]) + list_dot_product(l[t + 1:64], l[t + 1:64]) - 2 * list_dot_product(l[1:64 - t], l[t + 1:64]) AS d FROM u, (SELECT unnest(range(1, 63)) AS t) g), "
    "c AS (SELECT id, list(t * d / (s + 1e-7) ORDER BY t) AS c FROM (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY t) AS s FROM d) z GROUP BY id), "
    f"f AS (SELECT k, 8000 / (440 * pow(2, (lowest + k / 4.0 - 69) / 12)) AS lag FROM (SELECT ceil({LOW.format(63)}) AS lowest, trunc({LOW.format(10)}) AS highest) z, {grid('k', 200)} g WHERE lowest + k / 4.0 < highest + 1), "
    "p AS (SELECT k, lag, floor(lag)::BIGINT AS a, least(ceil(lag), 62)::BIGINT AS b FROM f) "
    f"SELECT id, k, {y('c[a] + (lag - a) * (c[b] - c[a])')} FROM c, p"
))

# --- codebooks: the first eight vectors


def book(spark, sf_dir, count: int = 8) -> np.ndarray:
    """The vectors with the smallest ids: as many as the codebook has words."""
    return np.array([r["x"] for r in fx.v(spark, sf_dir).orderBy("id").limit(count).collect()])


BOOK = f"{fx.V}, c AS (SELECT id AS c, n, x AS w FROM v WHERE id < 8)"
NEAREST = f"WITH {BOOK}, d AS (SELECT id, c, sum((x - w) * (x - w)) AS d FROM v JOIN c USING (n) GROUP BY id, c), q AS (SELECT id, min_by(c, d) AS q FROM d GROUP BY id)"


def vq(spark, sf_dir):
    return fx.v(spark, sf_dir).select("id", learners.vq("x", book(spark, sf_dir)).alias("q"))


def ivq(spark, sf_dir):
    words = book(spark, sf_dir)
    return fx.long(fx.v(spark, sf_dir).select("id", learners.ivq(learners.vq("x", words), words).alias("out")), ["id"], "out")


def msvq(spark, sf_dir):
    words = np.stack([book(spark, sf_dir), 0.1 * book(spark, sf_dir)])
    return fx.v(spark, sf_dir).select("id", F.posexplode(learners.msvq("x", words)).alias("k", "q")).select("id", F.col("k").cast("long").alias("k"), "q")


def imsvq(spark, sf_dir):
    words = np.stack([book(spark, sf_dir), 0.1 * book(spark, sf_dir)])
    return fx.long(fx.v(spark, sf_dir).select("id", learners.imsvq(learners.msvq("x", words), words).alias("out")), ["id"], "out")


QUERIES |= {"vq": vq, "ivq": ivq, "msvq": msvq, "imsvq": imsvq}
ORACLES["vq"] = f"{NEAREST} SELECT id, q FROM q"
ORACLES["ivq"] = f"{NEAREST} SELECT q.id, n AS k, {y('w')} FROM q JOIN c ON c.c = q.q"
STAGES = NEAREST + ", r AS (SELECT v.id, v.n, x - w AS x FROM v JOIN q USING (id) JOIN c ON c.c = q.q AND c.n = v.n), e AS (SELECT id, c, sum((x - 0.1 * w) * (x - 0.1 * w)) AS d FROM r JOIN c USING (n) GROUP BY id, c), p AS (SELECT id, min_by(c, d) AS q FROM e GROUP BY id)"
ORACLES["msvq"] = f"{STAGES} SELECT id, 0::BIGINT AS k, q FROM q UNION ALL SELECT id, 1::BIGINT AS k, q FROM p"
ORACLES["imsvq"] = f"{STAGES} SELECT q.id, a.n AS k, {y('a.w + 0.1 * b.w')} FROM q JOIN p USING (id) JOIN c a ON a.c = q.q JOIN c b ON b.c = p.q AND b.n = a.n"

# --- distances of neighbouring vectors


def pairs(spark, sf_dir):
    v = fx.v(spark, sf_dir)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")


PAIRS = f"{fx.V}, p AS (SELECT a.id, a.n, a.x, b.x AS y FROM v a JOIN v b ON b.id = a.id + 1 AND b.n = a.n)"


def rmse(spark, sf_dir):
    return fx.plain(metrics.rmse(pairs(spark, sf_dir), "none"), ["id"], "rmse")


def cdist(spark, sf_dir):
    return fx.plain(metrics.cdist(pairs(spark, sf_dir), True, "none"), ["id"], "cdist")


def cdist_mean(spark, sf_dir):
    return fx.plain(metrics.cdist(pairs(spark, sf_dir)), [], "cdist")


def dtw(spark, sf_dir):
    return fx.plain(pairs(spark, sf_dir).select("id", metrics.dtw("x", "y", 4).alias("d")), ["id"], "d")


def dtw_merge(spark, sf_dir):
    """Aligned frames: the two frames at every place of each warping, side by side."""
    both = pairs(spark, sf_dir).withColumn("path", metrics.dtw_path("x", "y", 4, p=1))
    steps = both.select("id", "x", "y", F.posexplode(F.transform(F.filter(F.sequence(F.lit(0), F.size("path") - 2, F.lit(2)), lambda k: F.get("path", k) >= 0), lambda k: F.struct(F.get("path", k).cast("int").alias("i"), F.get("path", k + 1).cast("int").alias("j")))).alias("t", "s"))
    return fx.long(steps.select("id", "t", F.concat(F.slice("x", F.col("s.i") * 4 + 1, F.lit(4)), F.slice("y", F.col("s.j") * 4 + 1, F.lit(4))).alias("out")), ["id", "t"], "out")


QUERIES |= {"rmse": rmse, "cdist": cdist, "cdist_mean": cdist_mean, "dtw": dtw, "dtw_merge": dtw_merge}
ORACLES["rmse"] = f"WITH {PAIRS} SELECT id, {y('sqrt(avg((x - y) * (x - y)))')} FROM p GROUP BY id"
ORACLES["cdist"] = f"WITH {PAIRS} SELECT id, {y('sqrt(sum((x - y) * (x - y))) * 10 * sqrt(2) / ln(10)')} FROM p WHERE n > 0 GROUP BY id"
ORACLES["cdist_mean"] = f"WITH {PAIRS}, d AS (SELECT id, sqrt(sum((x - y) * (x - y))) AS d FROM p WHERE n > 0 GROUP BY id) SELECT {y('avg(d) / sqrt(63)')} FROM d"

#: Rows of the table of warped costs, one after another, as lists: after any step, and after a step along both sequences.
GAP = "sqrt(list_sum(list_transform(range(4), lambda q: pow(x[{0} * 4 + q + 1] - y[{1} * 4 + q + 1], 2))))"
BOTH = f"list_transform(range(16), lambda j: CASE WHEN j = 0 THEN 1e300 ELSE reach[greatest(j, 1)] + 2 * {GAP.format('(i + 1)', 'j')} END)"
LEAST = "least(duo[j + 1] + g[j + 1], CASE WHEN j = 0 THEN 1e300 ELSE nxt[greatest(j, 1)] END + g[j + 1], nxt[j + 1])"
SOFT = " + ".join(f"exp(-(least({o}, 1e290) - least({LEAST}, 1e280)) / 1e-3)" for o in ("duo[j + 1] + g[j + 1]", "CASE WHEN j = 0 THEN 1e300 ELSE nxt[greatest(j, 1)] END + g[j + 1]", "nxt[j + 1]"))
ORACLES["dtw"] = (
    f"WITH RECURSIVE {fx.V}, l AS (SELECT id, list(x ORDER BY n) AS x FROM v GROUP BY id), p AS (SELECT a.id, a.x, b.x AS y FROM l a JOIN l b ON b.id = a.id + 1), "
    f"r AS (SELECT id, x, y, 0 AS i, list_transform(range(16), lambda j: CASE WHEN j = 0 THEN {GAP.format('0', '0')} ELSE 1e300 END) AS reach, list_transform(range(16), lambda j: 1e300) AS duo FROM p UNION ALL "
    f"SELECT id, x, y, i + 1 AS i, list_transform(range(16), lambda j: CASE WHEN {LEAST} >= 1e280 THEN 1e300 ELSE {LEAST} - 1e-3 * ln({SOFT}) END) AS reach, nxt AS duo "
    f"FROM (SELECT id, x, y, i, duo, {BOTH} AS nxt, list_transform(range(16), lambda j: {GAP.format('(i + 1)', 'j')}) AS g FROM r WHERE i < 15) z) "
    f"SELECT id, {y('reach[16] / 32')} FROM r WHERE i = 15"
)

# --- learners


def pca(spark, sf_dir):
    """The covariance put together from all components: rows i, k, y."""
    found = learners.pca(fx.v(spark, sf_dir), 64)
    whole = (found.directions.T * found.values) @ found.directions
    rows = spark.range(64).select(F.col("id").alias("i"), numbers(whole.reshape(-1)).alias("all")).select("i", F.slice("all", (F.col("i") * 64 + 1).cast("int"), F.lit(64)).alias("out"))
    return fx.long(rows, ["i"], "out")


def pca_transform(spark, sf_dir):
    """The squared length of each centred vector, from all its components."""
    vectors = fx.v(spark, sf_dir)
    found = learners.pca(vectors, 64)
    return fx.plain(vectors.select("id", F.aggregate(found.transform("x"), F.lit(0.0), lambda s, a: s + a * a).alias("y")), ["id"], "y")


def pca_whiten(spark, sf_dir):
    """The covariance of whitened vectors: rows i, k, y."""
    vectors = fx.v(spark, sf_dir)
    count, total, square = learners.moments(vectors.select(learners.pca(vectors, 64).whiten("x").alias("x")))
    cov = square / count - np.outer(total / count, total / count)
    rows = spark.range(64).select(F.col("id").alias("i"), numbers(cov.reshape(-1)).alias("all")).select("i", F.slice("all", (F.col("i") * 64 + 1).cast("int"), F.lit(64)).alias("out"))
    return fx.long(rows, ["i"], "out")


def parameters(spark, found: np.ndarray):
    """A small matrix as rows i, k, y."""
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(found)], "i long, out array<double>")
    return fx.long(rows, ["i"], "out")


def lbg_step(spark, sf_dir):
    """One round of a codebook from the vectors of the eight smallest ids: the mean of the vectors nearest to each word."""
    counts, sums, _ = learners.assigned(fx.v(spark, sf_dir), book(spark, sf_dir), "x")
    return parameters(spark, sums / counts[:, None])


def gmm_step(spark, sf_dir):
    """One round of a mixture of four, from the vectors of the smallest ids as means and unit variances: new means."""
    start = learners.Mixture(np.full(4, 0.25), book(spark, sf_dir, 4), np.stack([np.eye(64)] * 4))
    return parameters(spark, learners.gmm(fx.v(spark, sf_dir), 4, n_iter=1, start=start).means)


def lbg(spark, sf_dir):
    vectors = fx.v(spark, sf_dir)
    return vectors.select("id", learners.lbg(vectors, 8, n_iter=20, seed=1).transform("x").alias("q"))


def gmm(spark, sf_dir):
    vectors = fx.v(spark, sf_dir)
    return vectors.select("id", learners.gmm(vectors, 4, n_iter=10, seed=1).transform("x").alias("q"))


def ica(spark, sf_dir):
    vectors = fx.v(spark, sf_dir)
    return fx.long(vectors.select("id", learners.ica(vectors, 4, n_iter=30, seed=1).transform("x").alias("out")), ["id"], "out")


def nmf(spark, sf_dir):
    vectors = fx.v(spark, sf_dir).withColumn("x", F.transform("x", lambda a: F.abs(a) + 0.01))
    return fx.long(learners.nmf(vectors, 3, n_iter=20).activations, ["id"], "u")


QUERIES |= {"pca": pca, "pca_transform": pca_transform, "pca_whiten": pca_whiten, "lbg": lbg, "lbg_step": lbg_step, "gmm": gmm, "gmm_step": gmm_step, "ica": ica, "nmf": nmf}
ORACLES["pca"] = f"WITH {fx.V}, m AS (SELECT n, avg(x) AS m FROM v GROUP BY n), c AS (SELECT n, list(x - m ORDER BY id) AS l FROM v JOIN m USING (n) GROUP BY n) SELECT a.n AS i, b.n AS k, {y('list_dot_product(a.l, b.l) / len(a.l)')} FROM c a, c b"
ORACLES["pca_transform"] = f"WITH {fx.V}, m AS (SELECT n, avg(x) AS m FROM v GROUP BY n) SELECT id, {y('sum((x - m) * (x - m))')} FROM v JOIN m USING (n) GROUP BY id"
ORACLES["pca_whiten"] = f"SELECT i, k, {y('CASE WHEN i = k THEN 1.0 ELSE 0.0 END')} FROM {grid('i', 64)} a, {grid('k', 64)} b"
ORACLES["lbg_step"] = f"{NEAREST} SELECT q AS i, n AS k, {y('avg(x)')} FROM v JOIN q USING (id) GROUP BY q, n"
ORACLES["gmm_step"] = (
    f"WITH {fx.V}, c AS (SELECT id AS c, n, x AS w FROM v WHERE id < 4), d AS (SELECT id, c, sum((x - w) * (x - w)) AS d FROM v JOIN c USING (n) GROUP BY id, c), "
    "e AS (SELECT id, c, exp(-(d - min(d) OVER (PARTITION BY id)) / 2) AS e FROM d), p AS (SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS p FROM e) "
    f"SELECT c AS i, n AS k, {y('sum(p * x) / sum(p)')} FROM v JOIN p USING (id) GROUP BY c, n"
)
