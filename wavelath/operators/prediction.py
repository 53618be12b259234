"""Linear prediction, cepstra and their conversions: numpy on Arrow batches of vectors.

Every function takes a vector column and returns a column. Element 0 of a
coefficient vector is its gain. Constants are computed once, on the driver.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, col, require, tail, whole
from .pointwise import gamma_of, headed
from .transforms import fit_length, mc2b_matrix

ACORR_FORMATS = ("naive", "normalized", "biased", "unbiased")
SPECTRUM_FORMATS = ("db", "log-magnitude", "magnitude", "power")


def pick(names: tuple, given: str | int) -> str:
    name = names[given] if isinstance(given, int) else given
    if name not in names:
        raise ValueError(f"out_format is one of {names}")
    return name


def formatted(log_magnitude: np.ndarray, out_format: str | int) -> np.ndarray:
    kind = pick(SPECTRUM_FORMATS, out_format)
    if kind == "db":
        return log_magnitude * (20 / np.log(10))
    return log_magnitude if kind == "log-magnitude" else np.exp(log_magnitude * (1 if kind == "magnitude" else 2))


# --- autocorrelation and linear prediction


def correlate(x: np.ndarray, order: int) -> np.ndarray:
    spectrum = np.fft.rfft(x, 2 * x.shape[1])
    return np.fft.irfft(spectrum.real**2 + spectrum.imag**2)[:, : order + 1]


def acorr(x: Column | str, acr_order: int, out_format: str | int = "naive") -> Column:
    kind = pick(ACORR_FORMATS, out_format)

    def run(v: np.ndarray) -> np.ndarray:
        r, length = correlate(v, acr_order), v.shape[1]
        if kind == "normalized":
            return r / r[:, :1]
        return r / {"naive": 1, "biased": length, "unbiased": length - np.arange(acr_order + 1)}[kind]

    return batched(run, x)


def predictors(r: np.ndarray, eps: float) -> np.ndarray:
    """Gain and prediction coefficients of autocorrelations."""
    system = bases.toeplitz(r[:, :-1]) + eps * np.eye(r.shape[1] - 1)
    a = np.linalg.solve(system, -r[:, 1:, None])[..., 0]
    return np.column_stack([np.sqrt(np.sum(r[:, 1:] * a, axis=1) + r[:, 0]), a])


def levdur(r: Column | str, eps: float | None = None) -> Column:
    return batched(lambda v: predictors(v, eps or 0.0), r)


def lpc(x: Column | str, lpc_order: int, eps: float | None = None) -> Column:
    return batched(lambda v: predictors(correlate(v, lpc_order), eps or 0.0), x)


def rlevdur(a: Column | str, n_fft: int = 512) -> Column:
    """Autocorrelation of a predictor, from its spectrum at n_fft points of the upper half circle."""

    def run(v: np.ndarray) -> np.ndarray:
        order = v.shape[1] - 1
        poly = np.fft.rfft(np.column_stack([np.ones(len(v)), v[:, 1:]]), 2 * (n_fft - 1))
        return np.fft.irfft((v[:, :1] / np.abs(poly)) ** 2)[:, : order + 1]

    return batched(run, a)


def step_down(a: np.ndarray, gamma: float) -> np.ndarray:
    k = a.copy()
    k[:, 1:] *= gamma
    for m in range(a.shape[1] - 1, 1, -1):
        last, rest = k[:, m : m + 1], k[:, 1:m]
        k[:, 1:m] = (rest - last * rest[:, ::-1]) / (1 - last**2)
    return k


def step_up(k: np.ndarray, gamma: float) -> np.ndarray:
    """Prediction coefficients of reflection coefficients; gamma divides all of them, the gain too."""
    a = k.copy()
    for m in range(2, k.shape[1]):
        a[:, 1:m] += a[:, m : m + 1] * a[:, 1:m][:, ::-1]
    return a / gamma


def lpc2par(a: Column | str, gamma: float = 1, c: int | None = None) -> Column:
    g = gamma_of(gamma, c)
    return batched(lambda v: step_down(v, g), a)


def par2lpc(k: Column | str, gamma: float = 1, c: int | None = None) -> Column:
    g = gamma_of(gamma, c)
    return batched(lambda v: step_up(v, g), k)


def lpccheck(a: Column | str, margin: float = 1e-16) -> Column:
    """Reflection coefficients pulled inside the unit circle by margin."""

    def run(v: np.ndarray) -> np.ndarray:
        k = step_down(v, 1.0)
        k[:, 1:] = np.clip(k[:, 1:], -(1 - margin), 1 - margin)
        return step_up(k, 1.0)

    return batched(run, a)


def lpc_is_stable(a: Column | str) -> Column:
    return F.forall(tail(lpc2par(a)), lambda k: F.abs(k) < 1)


# --- line spectral pairs

LSP_FORMATS = ("radian", "cycle", "khz", "hz")


def angle_unit(name: str | int, sample_rate: float | None) -> float:
    name = pick(LSP_FORMATS, name)
    if name in ("khz", "hz"):
        require(sample_rate_is_needed=sample_rate is not None)
    return {"radian": 1.0, "cycle": 1 / (2 * np.pi), "khz": (sample_rate or 0) / (2000 * np.pi), "hz": (sample_rate or 0) / (2 * np.pi)}[name]


def companions(poly: np.ndarray) -> np.ndarray:
    """Companion matrices of polynomials, highest power first."""
    n = poly.shape[1] - 1
    out = np.zeros((len(poly), n, n))
    out[:, np.arange(1, n), np.arange(n - 1)] = 1
    out[:, 0] = -poly[:, 1:] / poly[:, :1]
    return out


def lpc2lsp(a: Column | str, log_gain: bool = False, sample_rate: float | None = None, out_format: str | int = "radian") -> Column:
    unit = angle_unit(out_format, sample_rate)

    def run(v: np.ndarray) -> np.ndarray:
        order = v.shape[1] - 1
        ahead = np.column_stack([np.ones(len(v)), v[:, 1:], np.zeros(len(v))])
        even = order % 2 == 0
        sums = deflated(ahead + ahead[:, ::-1], [1.0, 1.0] if even else [1.0])
        differences = deflated(ahead - ahead[:, ::-1], [1.0, -1.0] if even else [1.0, 0.0, -1.0])
        # what is left has its roots in pairs on the circle
        angles = [np.sort(np.angle(np.linalg.eigvals(companions(p))), axis=1)[:, (p.shape[1] - 1) // 2 :] for p in (sums, differences) if p.shape[1] > 1]
        gain = np.log(v[:, :1]) if log_gain else v[:, :1]
        return np.column_stack([gain, np.sort(np.column_stack([np.zeros((len(v), 0)), *angles]), axis=1) * unit])

    return batched(run, a)


def deflated(poly: np.ndarray, factor: list[float]) -> np.ndarray:
    """Quotients by a monic factor that divides."""
    out = poly.copy()
    for k in range(poly.shape[1]):
        for j in range(1, min(k + 1, len(factor))):
            out[:, k] -= factor[j] * out[:, k - j]
    return out[:, : poly.shape[1] - len(factor) + 1]


def grow(poly: np.ndarray, factor: list) -> np.ndarray:
    """Products of polynomials by factors given as columns."""
    out = np.zeros((len(poly), poly.shape[1] + len(factor) - 1), poly.dtype)
    for k, f in enumerate(factor):
        out[:, k : k + poly.shape[1]] += poly * (f[:, None] if isinstance(f, np.ndarray) else f)
    return out


def line_polynomials(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symmetric and the antisymmetric polynomial of line spectral frequencies (radians)."""
    order = w.shape[1]
    p = q = np.ones((len(w), 1))
    for k in range(order):
        pair = [1.0, -2 * np.cos(w[:, k]), 1.0]
        p, q = (grow(p, pair), q) if k % 2 == 0 else (p, grow(q, pair))
    if order % 2 == 0:
        return grow(p, [1.0, 1.0]), grow(q, [1.0, -1.0])
    return p, grow(q, [1.0, 0.0, -1.0])


def lsp2lpc(w: Column | str, log_gain: bool = False, sample_rate: float | None = None, in_format: str | int = "radian") -> Column:
    unit = angle_unit(in_format, sample_rate)

    def run(v: np.ndarray) -> np.ndarray:
        p, q = line_polynomials(v[:, 1:] / unit)
        gain = np.exp(v[:, :1]) if log_gain else v[:, :1]
        return np.column_stack([gain, (0.5 * (p + q))[:, 1 : v.shape[1]]])

    return batched(run, w)


def lsp2sp(w: Column | str, fft_length: int, alpha: float = 0, gamma: float = -1, log_gain: bool = False, out_format: str | int = "power") -> Column:
    """Spectrum of line spectral pairs: half the sum of their two polynomials, evaluated on the (warped) circle."""
    grid = bases.warp_grid(fft_length, alpha)

    def run(v: np.ndarray) -> np.ndarray:
        p, q = line_polynomials(v[:, 1:])
        model = 0.5 * (p + q) @ np.exp(-1j * np.outer(np.arange(p.shape[1]), grid))
        gain = v[:, :1] if log_gain else np.log(v[:, :1])
        with np.errstate(divide="ignore"):
            return formatted(gain + np.log(np.abs(model)) / gamma, out_format)

    return batched(run, w)


def lspcheck(w: Column | str, rate: float = 0, n_iter: int = 1) -> Column:
    """Neighbours nearer than rate * pi / (order + 1) are moved apart, sweep by sweep, and kept inside the range."""

    def run(v: np.ndarray) -> np.ndarray:
        out = v.copy()
        least = rate * np.pi / v.shape[1]
        for _ in range(n_iter):
            for m in range(1, v.shape[1] - 1):
                lack = np.maximum(least - (out[:, m + 1] - out[:, m]), 0) / 2
                out[:, m] -= lack
                out[:, m + 1] += lack
            out[:, 1:] = np.clip(out[:, 1:], least, np.pi - least)
        return out

    return batched(run, w)


def lsp_is_stable(w: Column | str) -> Column:
    x = tail(col(w))
    return F.forall(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), tail(x), lambda a, b: b > a), lambda ok: ok) & F.forall(x, lambda v: (v > 0) & (v < float(np.pi)))


# --- polynomials


def root_pol(a: Column | str, part: str = "real") -> Column:
    """Roots by falling size, then angle; part is real, imaginary, radius or angle."""
    get = {"real": np.real, "imaginary": np.imag, "radius": np.abs, "angle": np.angle}[part]

    def run(v: np.ndarray) -> np.ndarray:
        if (v[:, 0] == 0).any():
            raise ValueError("the leading coefficient is zero")
        roots = np.linalg.eigvals(companions(v)).astype(complex)
        order = np.lexsort((np.angle(roots), np.round(-np.abs(roots), 9)), axis=1)
        return get(np.take_along_axis(roots, order, axis=1))

    return batched(run, a)


def pol_root(re: Column | str, im: Column | str | None = None, polar: bool = False, part: str = "real") -> Column:
    """Coefficients of the polynomial with the given roots (re, im) or (radius, angle)."""
    get = np.real if part == "real" else np.imag

    def run(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        y = np.zeros_like(x) if y is None else y
        roots = x * np.exp(1j * y) if polar else x + 1j * y
        poly = np.ones((len(x), 1), complex)
        for m in range(x.shape[1]):
            poly = grow(poly, [1.0, -roots[:, m]])
        return get(poly)

    return batched(run, *([re] if im is None else [re, im]))


def csm_matrix(order: int) -> np.ndarray:
    """Powers of a cosine as sums of cosines: entry (n, k) is the weight of cos(k x) in cos(x)**n."""
    out = np.zeros((order + 1, order + 1))
    for n in range(order + 1):
        for j in range(n + 1):
            out[n, abs(n - 2 * j)] += comb(n, j) / 2**n
    return out


def acr2csm(r: Column | str, acr_order: int) -> Column:
    """Composite sinusoidal model of an autocorrelation: frequencies in rising order, then their intensities."""
    moments = csm_matrix(acr_order)

    def run(v: np.ndarray) -> np.ndarray:
        u = v @ moments.T
        half = v.shape[1] // 2
        p = np.linalg.solve(bases.hankel(-u[:, : 2 * half - 1]), u[:, half:, None])[..., 0]
        roots = np.linalg.eigvals(companions(np.column_stack([np.ones(len(v)), p[:, ::-1]])))
        x = -np.sort(-roots.real, axis=1)
        powers = x[:, None, :] ** np.arange(half)[:, None]
        m = np.linalg.solve(powers, u[:, :half, None])[..., 0]
        return np.column_stack([np.arccos(x), m])

    return batched(run, r)


# --- cepstra


def c2acr(c: Column | str, acr_order: int, n_fft: int = 512) -> Column:
    return batched(lambda v: np.fft.hfft(np.exp(2 * np.fft.rfft(v, n_fft).real), n_fft)[:, : acr_order + 1] / n_fft, c)


def c2mpir(c: Column | str, ir_length: int, n_fft: int = 512) -> Column:
    return batched(lambda v: np.fft.irfft(np.exp(np.fft.rfft(v, n_fft)), n_fft)[:, :ir_length], c)


def mpir2c(h: Column | str, cep_order: int, n_fft: int = 512) -> Column:
    def run(v: np.ndarray) -> np.ndarray:
        c = np.fft.irfft(np.log(np.abs(np.fft.rfft(v, n_fft))), n_fft)[:, : cep_order + 1]
        c[:, 1:] *= 2
        return c

    return batched(run, h)


def fftcep(x: Column | str, fft_length: int, cep_order: int, accel: float = 0, n_iter: int = 0) -> Column:
    """Cepstrum of a power spectrum; further rounds follow the spectrum's upper edge."""

    def run(v: np.ndarray) -> np.ndarray:
        half, n = fft_length // 2, cep_order + 1
        rest = np.fft.irfft(np.log(v), fft_length)[:, : half + 1]
        c = rest[:, :n].copy()
        rest[:, :n] = 0
        for _ in range(n_iter):
            above = np.maximum(np.fft.hfft(rest, fft_length), 0)
            rest = np.fft.ihfft(above).real
            step = rest[:, :n] * (1 + accel)
            c += step
            rest[:, :n] -= step
        c[:, 0] *= 0.5
        if cep_order == half:
            c[:, -1] *= 0.5
        return c

    return batched(run, x)


def newton_cepstrum(power: np.ndarray, waves: np.ndarray, mc: np.ndarray, gamma: float, n_iter: int) -> np.ndarray:
    """Newton steps for the least mean of X / |H|^2 + log |H|^2 over the circle.

    H is the generalised model of mc on waves, the warped powers of z at each bin, up to twice the order.
    """
    order, bins = mc.shape[1] - 1, power.shape[1]
    weight = np.full(bins, 2.0)
    weight[[0, -1]] = 1.0
    weight /= weight.sum()
    n = np.arange(order + 1)
    for _ in range(n_iter):
        model = mc @ waves[: order + 1]
        a = 1 + gamma * model
        log_power = 2 * (model.real if gamma == 0 else np.log(np.abs(a)) / gamma)
        ratio = power * np.exp(-log_power)
        if gamma == 0:
            # products of waves are sums of waves: the system is a Toeplitz and a Hankel matrix of one series
            series = (ratio * weight) @ waves.real.T
            gradient = waves[: order + 1].real @ weight - series[:, : order + 1]
            system = bases.toeplitz(series[:, : order + 1]) + bases.hankel(series)
        else:
            slope = 2 * (waves[: order + 1] / a[:, None, :]).real
            gradient = np.einsum("bmw,bw->bm", slope, weight * (1 - ratio))
            system = np.einsum("bmw,bnw->bmn", slope * (weight * ratio)[:, None], slope)
            bend = np.einsum("bw,mw->bm", weight * (1 - ratio) / a**2, waves).real * (-2 * gamma)
            system += bend[:, n[:, None] + n]
        mc = mc - np.linalg.solve(system, gradient[..., None])[..., 0]
    return mc


def first_cepstrum(power: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The plain cepstrum of a power spectrum, warped."""
    c = np.fft.irfft(np.log(power))[:, : power.shape[1]]
    c[:, [0, -1]] *= 0.5
    return c @ matrix.T


def mcep(x: Column | str, fft_length: int, cep_order: int, alpha: float = 0, n_iter: int = 0) -> Column:
    """Mel-cepstrum of a power spectrum."""
    half = fft_length // 2
    matrix = bases.freqt_matrix(half, cep_order, alpha)
    waves = np.fft.rfft(bases.freqt_matrix(2 * cep_order, half, -alpha).T, fft_length)
    return batched(lambda v: newton_cepstrum(v, waves, first_cepstrum(v, matrix), 0.0, n_iter), x)


def smcep(x: Column | str, fft_length: int, cep_order: int, alpha: float = 0, theta: float = 0, n_iter: int = 0, accuracy_factor: int = 4) -> Column:
    """Mel-cepstrum by second-order warping."""
    half = fft_length // 2
    matrix = bases.freqt2_matrix(half, cep_order, alpha, theta, fft_length * accuracy_factor)
    waves = np.fft.rfft(bases.freqt2_matrix(2 * cep_order, half, alpha, theta, fft_length * accuracy_factor, inverse=True).T, fft_length)
    return batched(lambda v: newton_cepstrum(v, waves, first_cepstrum(v, matrix), 0.0, n_iter), x)


def mgcep(x: Column | str, fft_length: int, cep_order: int, alpha: float = 0, gamma: float = 0, c: int | None = None, n_iter: int = 0) -> Column:
    """Mel-generalised cepstrum of a power spectrum: prediction on the warped axis, then Newton steps."""
    g = gamma_of(gamma, c)
    require(gamma_is_between_minus_1_and_0=-1 <= g <= 0)
    if g == 0:
        return mcep(x, fft_length, cep_order, alpha, n_iter)
    waves = np.exp(-1j * np.arange(2 * cep_order + 1)[:, None] * bases.warp_grid(fft_length, alpha))
    weight = np.full(fft_length // 2 + 1, 2.0)
    weight[[0, -1]] = 1.0
    weight /= weight.sum()

    def run(v: np.ndarray) -> np.ndarray:
        ar = predictors((v * weight) @ waves[: cep_order + 1].real.T, 0.0)
        # a predictor is a gain-normalised model of gamma -1: 1 / (1 + sum a z^-m)
        start = np.column_stack([ar[:, :1], -ar[:, 1:]])
        mc = convert_cepstrum(start, cep_order, -1.0, g, 0.0, True, False, False, False, 2 * fft_length)
        return newton_cepstrum(v, waves, mc, g, n_iter)

    return batched(run, x)


def normalised(c: np.ndarray, gamma: float) -> np.ndarray:
    if gamma == 0:
        return np.column_stack([np.exp(c[:, 0]), c[:, 1:]])
    z = 1 + gamma * c[:, :1]
    return np.column_stack([z ** (1 / gamma), c[:, 1:] / z])


def unnormalised(c: np.ndarray, gamma: float) -> np.ndarray:
    if gamma == 0:
        return np.column_stack([np.log(c[:, 0]), c[:, 1:]])
    z = c[:, :1] ** gamma
    return np.column_stack([(z - 1) / gamma, c[:, 1:] * z])


def convert_cepstrum(c, out_order, in_gamma, out_gamma, alpha, in_norm, out_norm, in_mul, out_mul, n_fft):
    """Changes the order, warping (by alpha), power parameter and form of generalised cepstra; steps that change nothing are left out."""
    c = c.copy()
    if in_mul and in_gamma != 0:
        if not in_norm:
            c[:, 0] -= 1
            c[:, 0] /= in_gamma
        c[:, 1:] /= in_gamma
    if alpha != 0:
        c = unnormalised(c, in_gamma) if in_norm else c
        c, in_norm = c @ bases.freqt_matrix(c.shape[1] - 1, out_order, alpha).T, False
    if in_gamma != out_gamma:
        c, in_norm = c if in_norm else normalised(c, in_gamma), True
        model = np.fft.rfft(np.column_stack([np.zeros(len(c)), c[:, 1:]]), n_fft)
        log_h = model if in_gamma == 0 else np.log(1 + in_gamma * model) / in_gamma
        new = log_h if out_gamma == 0 else np.expm1(out_gamma * log_h) / out_gamma
        # the model is causal: its real part alone gives the coefficients, twice
        rest = np.fft.irfft(new, n_fft)[:, 1 : out_order + 1]
        c = np.column_stack([c[:, :1], rest])
    c = fit_length(c, out_order + 1)
    if in_norm and not out_norm:
        c = unnormalised(c, out_gamma)
    elif out_norm and not in_norm:
        c = normalised(c, out_gamma)
    if out_mul and out_gamma != 0:
        c = c.copy()
        c[:, 1:] *= out_gamma
        if not out_norm:
            c[:, 0] = c[:, 0] * out_gamma + 1
    return c


def between(in_alpha: float, out_alpha: float) -> float:
    return (out_alpha - in_alpha) / (1 - in_alpha * out_alpha)


def mgc2mgc(
    mc: Column | str, out_order: int, in_alpha: float = 0, out_alpha: float = 0, in_gamma: float = 0, out_gamma: float = 0,
    in_norm: bool = False, out_norm: bool = False, in_mul: bool = False, out_mul: bool = False, n_fft: int = 512,
) -> Column:
    alpha = between(in_alpha, out_alpha)
    return batched(lambda v: convert_cepstrum(v, out_order, in_gamma, out_gamma, alpha, in_norm, out_norm, in_mul, out_mul, n_fft), mc)


MGC_FORMATS = (*SPECTRUM_FORMATS, "cycle", "radian", "degree")


def mgc2sp(mc: Column | str, fft_length: int, alpha: float = 0, gamma: float = 0, norm: bool = False, mul: bool = False, n_fft: int = 512, out_format: str | int = "power") -> Column:
    """Spectrum or phase of a mel-generalised cepstrum."""
    kind = pick(MGC_FORMATS, out_format)

    def run(v: np.ndarray) -> np.ndarray:
        c = convert_cepstrum(v, fft_length // 2, gamma, 0.0, between(alpha, 0.0), norm, False, mul, False, n_fft)
        log_h = np.fft.rfft(c, fft_length)
        if kind in SPECTRUM_FORMATS:
            return formatted(log_h.real, kind)
        return log_h.imag * {"cycle": 1 / (2 * np.pi), "radian": 1.0, "degree": 180 / np.pi}[kind]

    return batched(run, mc)


def energy(mc: np.ndarray, matrix: np.ndarray, ir_length: int) -> np.ndarray:
    """Energy of the impulse response of mel-cepstra."""
    return np.fft.hfft(np.exp(2 * np.fft.rfft(mc @ matrix.T, ir_length).real), ir_length)[:, :1] / ir_length


def mcpf(mc: Column | str, cep_order: int, alpha: float = 0, beta: float = 0, onset: int = 2, ir_length: int = 128) -> Column:
    """Post-filter: coefficients from onset on are raised by beta, and the energy stays."""
    plain, to_b = bases.freqt_matrix(cep_order, ir_length - 1, -alpha), mc2b_matrix(cep_order, alpha)
    weight = np.where(np.arange(cep_order + 1) >= onset, 1 + beta, 1.0)

    def run(v: np.ndarray) -> np.ndarray:
        raised = v * weight
        b = raised @ to_b.T
        b[:, :1] += 0.5 * np.log(energy(v, plain, ir_length) / energy(raised, plain, ir_length))
        return b + alpha * np.column_stack([b[:, 1:], np.zeros(len(b))])

    return batched(run, mc)


def pnorm(mc: Column | str, cep_order: int, alpha: float = 0, ir_length: int = 128) -> Column:
    """Log power, then the cepstrum of unit power."""
    plain = bases.freqt_matrix(cep_order, ir_length - 1, -alpha)

    def run(v: np.ndarray) -> np.ndarray:
        p = np.log(energy(v, plain, ir_length))
        return np.column_stack([p, v[:, :1] - p / 2, v[:, 1:]])

    return batched(run, mc)


#: Largest log amplitudes for stable filters by order of the Pade approximation, strict and not.
PADE_LIMITS = {4: (4.5, 6.20), 5: (6.0, 7.65), 6: (7.4, 9.13), 7: (8.9, 10.6)}


def mlsacheck(mc: Column | str, alpha: float = 0, pade_order: int = 4, strict: bool = True, threshold: float | None = None, fast: bool = True, n_fft: int = 256, mod_type: str = "scale") -> Column:
    """Mel-cepstra scaled or clipped to what a filter can follow.

    What stands beside the gain has a log amplitude at each bin; fast looks at the one of 0 Hz only. scale divides all
    coefficients by what the largest is too large, clip each bin by its own.
    """
    limit = threshold if threshold is not None else PADE_LIMITS[pade_order][0 if strict else 1]
    require(clip_needs_the_full_spectrum=not (fast and mod_type == "clip"), mod_type_is_scale_or_clip=mod_type in ("scale", "clip"))

    def run(v: np.ndarray) -> np.ndarray:
        first = np.eye(1, v.shape[1])
        gain = np.polynomial.polynomial.polyval(-float(alpha), v.T)[:, None] * first
        shape = v - gain
        response = shape.sum(1, keepdims=True) if fast else np.fft.rfft(shape, n_fft)
        amplitude = response if fast else np.abs(response)
        excess = np.maximum(amplitude / limit, 1.0)
        if mod_type == "scale":
            return gain + shape / excess.max(axis=1, keepdims=True)
        return gain + np.fft.irfft(response / excess, n_fft)[:, : v.shape[1]]

    return batched(run, mc)
