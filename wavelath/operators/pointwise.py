"""Companding, quantisation and gain: column functions that stay in generated code.

Functions of a number take and return a double column; functions of a
coefficient vector take an array whose element 0 is the gain. Nulls give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import col, require, tail, whole


def alaw(x: Column | str, abs_max: float = 1, a: float = 87.6) -> Column:
    require(abs_max_is_positive=abs_max > 0, a_is_at_least_1=a >= 1)
    u = F.abs(col(x)) / abs_max
    curve = F.when(u < 1 / a, a * u).otherwise(1 + F.ln(F.greatest(a * u, F.lit(1.0))))
    return F.signum(col(x)) * curve * (abs_max / (1 + math.log(a)))


def ialaw(y: Column | str, abs_max: float = 1, a: float = 87.6) -> Column:
    require(abs_max_is_positive=abs_max > 0, a_is_at_least_1=a >= 1)
    v = F.abs(col(y)) / abs_max * (1 + math.log(a))
    return F.signum(col(y)) * F.when(v < 1, v).otherwise(F.exp(v - 1)) * (abs_max / a)


def ulaw(x: Column | str, abs_max: float = 1, mu: float = 255) -> Column:
    require(abs_max_is_positive=abs_max > 0, mu_is_positive=mu > 0)
    return F.signum(col(x)) * F.log1p(F.abs(col(x)) * (mu / abs_max)) * (abs_max / math.log1p(mu))


def iulaw(y: Column | str, abs_max: float = 1, mu: float = 255) -> Column:
    require(abs_max_is_positive=abs_max > 0, mu_is_positive=mu > 0)
    return F.signum(col(y)) * (F.pow(F.lit(1.0 + mu), F.abs(col(y)) / abs_max) - 1) * (abs_max / mu)


def levels(n_bit: int, quantizer: str | int) -> tuple[int, bool]:
    rise = quantizer in (0, "mid-rise")
    require(n_bit_is_positive=n_bit > 0, quantizer_is_mid_rise_or_mid_tread=rise or quantizer in (1, "mid-tread"))
    return (1 << n_bit) - (0 if rise else 1), rise


def quantize(x: Column | str, abs_max: float = 1, n_bit: int = 8, quantizer: str | int = "mid-rise") -> Column:
    """Whole numbers from 0 to the number of levels less one; mid-tread rounds half away from zero."""
    count, rise = levels(n_bit, quantizer)
    scaled = col(x) * (count / (2 * abs_max))
    placed = F.floor(scaled + count // 2) if rise else F.signum(scaled + (count - 1) // 2) * F.floor(F.abs(scaled + (count - 1) // 2) + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), placed)).cast("long")


def dequantize(y: Column | str, abs_max: float = 1, n_bit: int = 8, quantizer: str | int = "mid-rise") -> Column:
    count, rise = levels(n_bit, quantizer)
    value = (col(y) - (count // 2 - (0.5 if rise else 0.0))) * (2 * abs_max / count)
    return F.greatest(F.lit(-float(abs_max)), F.least(F.lit(float(abs_max)), value))


def gamma_of(gamma: float, c: int | None) -> float:
    """The power parameter: -1 / c where c is given."""
    require(c_is_at_least_1=not c or c >= 1)
    return -1 / c if c else gamma


def headed(first: Column, rest: Column) -> Column:
    return F.concat(F.array(first), rest)


def gnorm(x: Column | str, gamma: float = 0, c: int | None = None) -> Column:
    """Gain normalisation of a generalised cepstrum."""
    g, x = gamma_of(gamma, c), col(x)
    if g == 0:
        return headed(F.exp(whole(x, 0)), tail(x))
    z = 1 + g * whole(x, 0)
    return headed(F.pow(z, F.lit(1 / g)), F.transform(tail(x), lambda v: v / z))


def ignorm(y: Column | str, gamma: float = 0, c: int | None = None) -> Column:
    g, y = gamma_of(gamma, c), col(y)
    if g == 0:
        return headed(F.ln(whole(y, 0)), tail(y))
    z = F.pow(whole(y, 0), F.lit(float(g)))
    return headed((z - 1) / g, F.transform(tail(y), lambda v: v * z))


def norm0(a: Column | str) -> Column:
    """All-pole coefficients with gain as all-zero ones."""
    gain = F.nullif(whole(a, 0), F.lit(0.0))
    return headed(1 / gain, F.transform(tail(col(a)), lambda v: v / gain))


def par2is(k: Column | str) -> Column:
    edge = 1 - 1e-6
    return headed(whole(k, 0), F.transform(tail(col(k)), lambda v: F.asin(F.greatest(F.lit(-edge), F.least(F.lit(edge), v))) * (2 / math.pi)))


def is2par(s: Column | str) -> Column:
    return headed(whole(s, 0), F.transform(tail(col(s)), lambda v: F.sin(v * (math.pi / 2))))


def par2lar(k: Column | str) -> Column:
    return headed(whole(k, 0), F.transform(tail(col(k)), lambda v: 2 * F.atanh(v)))


def lar2par(g: Column | str) -> Column:
    return headed(whole(g, 0), F.transform(tail(col(g)), lambda v: F.tanh(v / 2)))


def ipnorm(y: Column | str) -> Column:
    """Power and cepstrum back to a cepstrum."""
    y = col(y)
    return headed(whole(y, 0) / 2 + whole(y, 1), tail(y, 2))


def b2mc(b: Column | str, alpha: float = 0) -> Column:
    b = col(b)
    return F.zip_with(b, F.concat(tail(b), F.array(F.lit(0.0))), lambda here, after: here + alpha * after)


def csm2acr(c: Column | str) -> Column:
    """Autocorrelation of a composite sinusoidal model: half frequencies, half intensities."""
    c = col(c)
    half = F.floor(F.size(c) / 2).cast("int")
    w, m = F.slice(c, F.lit(1), half), F.slice(c, half + 1, half)
    wave = lambda k: F.aggregate(F.zip_with(w, m, lambda a, b: b * F.cos(a * k)), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), F.size(c) - 1), wave)


def entropy(p: Column | str, out_format: str | int = "nat") -> Column:
    """Entropy of a vector of shares; a negative share gives minus infinity."""
    scale = {0: 1 / math.log(2), "bit": 1 / math.log(2), 1: 1.0, "nat": 1.0, 2: 1 / math.log(10), "dit": 1 / math.log(10)}[out_format]
    own = lambda v: F.when(v > 0, -v * F.ln(v)).when(v < 0, F.lit(float("-inf"))).otherwise(0.0)
    return F.aggregate(col(p), F.lit(0.0), lambda s, v: s + own(v)) * scale
