"""Queries of sequence operators over events, each with the SQL of its definition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import delayband, filters, metrics, pointwise, sequences, spectra, transforms, voice
from ..sources import samples as src
from . import fixtures as fx
from .fixtures import PI, grid, y

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def samples(name: str, op, sql: str | None, source=fx.w, cte: str = fx.W, digits: int = 6) -> None:
    """A query (seq, n, y) of an operator that gives samples."""
    register(name, lambda spark, sf_dir: fx.plain(op(source(spark, sf_dir)), ["seq", "n"], "x", digits), sql and f"WITH {cte} {sql}")


def vectors(name: str, op, sql: str | None, source=fx.w, cte: str = fx.W, place: str = "t", digits: int = 6) -> None:
    """A query (seq, t, k, y) of an operator that gives vectors."""
    register(name, lambda spark, sf_dir: fx.long(op(source(spark, sf_dir)), ["seq", place], "x", digits), sql and f"WITH {cte} {sql}")


def each(name: str, op, expression: str, source=fx.unit, cte: str = fx.UNIT) -> None:
    """A query of a function of numbers."""
    samples(name, lambda df: df.withColumn("x", op(F.col("x"))), f"SELECT seq, n, {y(expression)} FROM w", source, cte)


# --- framing and resampling


def framed(length: int, period: int, value: str = "x", name: str = "f", left: int | None = None, end: str = "") -> str:
    """SQL of centred frames (seq, t, j, x), zeros outside."""
    left = length // 2 if left is None else left
    return (
        f"{name} AS (SELECT s.seq, t, j, coalesce({value}, 0) AS x FROM (SELECT seq, len, unnest(range((len{end} + {period - 1}) // {period})) AS t FROM s) s CROSS JOIN {grid('j', length)} g "
        f"LEFT JOIN w ON w.seq = s.seq AND w.n = t * {period} + j - {left})"
    )


vectors("frame", lambda df: sequences.frame(df, 8, 4), f", {framed(8, 4)} SELECT seq, t, j AS k, {y('x')} FROM f")
vectors("frame_zmean", lambda df: sequences.frame(df, 8, 4, zmean=True), f", {framed(8, 4)} SELECT seq, t, j AS k, {y('x - avg(x) OVER (PARTITION BY seq, t)')} FROM f")
vectors("frame_reflect", lambda df: sequences.frame(df, 8, 4, mode="reflect"), (
    ", f AS (SELECT s.seq, t, j, len, t * 4 + j - 4 AS m FROM (SELECT seq, len, unnest(range((len + 3) // 4)) AS t FROM s) s CROSS JOIN " + grid("j", 8) + " g) "
    f"SELECT f.seq, t, j AS k, {y('x')} FROM f JOIN w ON w.seq = f.seq AND w.n = CASE WHEN m < 0 THEN -m WHEN m >= len THEN 2 * (len - 1) - m ELSE m END"
))


def covered(length: int, period: int, last: int) -> str:
    """SQL of samples weighted by the squared windows of the frames that hold them, over the sum of those."""
    squared = f"pow(0.5 - 0.5 * cos(2 * pi() * (w.n + {length // 2} - t * {period}) / {length - 1}), 2)"
    return (
        f", c AS (SELECT w.seq, w.n, x, sum({squared}) AS c FROM w JOIN (SELECT seq, unnest(range((len + {period - 1}) // {period})) AS t FROM s) f ON f.seq = w.seq AND w.n + {length // 2} - t * {period} BETWEEN 0 AND {last} GROUP BY w.seq, w.n, x) "
        f"SELECT seq, n, {y('x * c / (c + 1e-16)')} FROM c"
    )


samples("unframe", lambda df: sequences.unframe(sequences.frame(df, 8, 4).withColumn("x", transforms.window("x", 8, window="hanning", norm="none")), 8, 4, window="hanning").join(sequences.lengths(df), "seq").filter("n < length"), covered(8, 4, 7))
samples("delay", lambda df: sequences.delay(df, 3, keeplen=True), f"SELECT seq, n, {y('coalesce(lag(x, 3) OVER (PARTITION BY seq ORDER BY n), 0)')} FROM w")
samples("advance", lambda df: sequences.delay(df, -3), f"SELECT seq, n - 3 AS n, {y('x')} FROM w WHERE n >= 3")
samples("decimate", lambda df: sequences.decimate(df, 3, 1), f"SELECT seq, (n - 1) // 3 AS n, {y('x')} FROM w WHERE n % 3 = 1")
samples("interpolate", lambda df: sequences.interpolate(df, 3, 1), (
    f"SELECT s.seq, p.n, {y('coalesce(x, 0)')} FROM (SELECT seq, unnest(range(len * 3 + 1)) AS n FROM s) p JOIN s USING (seq) LEFT JOIN w ON w.seq = p.seq AND w.n * 3 + 1 = p.n"
))
samples("linear_intpl", lambda df: sequences.linear_intpl(df, 4), (
    f"SELECT seq, n * 4 + i AS n, {y('x + (coalesce(z, x) - x) * i / 4')} FROM (SELECT *, lead(x) OVER (PARTITION BY seq ORDER BY n) AS z FROM w) q, {grid('i', 4)} g"
))
samples("magic_intpl", sequences.magic_intpl, (
    ", a AS (SELECT *, max(CASE WHEN x <> 0 THEN n END) OVER (PARTITION BY seq ORDER BY n) AS p, min(CASE WHEN x <> 0 THEN n END) OVER (PARTITION BY seq ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM w) "
    f"SELECT a.seq, a.n, {y('CASE WHEN a.x <> 0 THEN a.x ELSE coalesce(b.x + (c.x - b.x) * (a.n - p) / nullif(q - p, 0), b.x, c.x, a.x) END')} FROM a LEFT JOIN w b ON b.seq = a.seq AND b.n = p LEFT JOIN w c ON c.seq = a.seq AND c.n = q"
), fx.u, fx.U)
AROUND = "OVER (PARTITION BY seq ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
samples("medfilt", lambda df: sequences.medfilt(df, 5, 0), (
    f"SELECT seq, n, {y(f'CASE WHEN sum(CASE WHEN x = 0 THEN 1 ELSE -1 END) {AROUND} > 0 THEN 0 ELSE quantile_cont(nullif(x, 0), 0.5) {AROUND} END')} FROM w"
), fx.u, fx.U)
CLAMP = "greatest(0, least(len - 1, w.n + {0}))"
vectors("delta", lambda df: sequences.delta(df), (
    f"SELECT w.seq, w.n, k, {y('CASE k WHEN 0 THEN w.x WHEN 1 THEN (b.x - a.x) / 2 ELSE a.x - 2 * w.x + b.x END')} FROM w JOIN s USING (seq) JOIN w a ON a.seq = w.seq AND a.n = {CLAMP.format(-1)} JOIN w b ON b.seq = w.seq AND b.n = {CLAMP.format(1)}, {grid('k', 3)} g"
), place="n")
register("zcross", lambda spark, d: fx.plain(sequences.zcross(fx.unit(spark, d), 8, softness=0.1), ["seq", "t"]), (
    f"WITH {fx.UNIT}, d AS (SELECT seq, n, abs(tanh(x / 0.1) - tanh(coalesce(lag(x) OVER (PARTITION BY seq ORDER BY n), x) / 0.1)) AS d FROM w) "
    f"SELECT seq, n // 8 AS t, {y('sum(d) / 2')} FROM d GROUP BY seq, n // 8 HAVING count(*) = 8"
))
register("histogram", lambda spark, d: fx.long(sequences.histogram(fx.w(spark, d), 10, 0, 500, softness=5.0), ["seq"], "x"), (
    f"WITH {fx.W} SELECT seq, k, {y('sum(1 / (1 + exp(-(x - k * 50) / 5)) - 1 / (1 + exp(-(x - (k + 1) * 50) / 5)))')} FROM w, {grid('k', 10)} g GROUP BY seq, k"
))

# --- companding and quantisation

each("alaw", pointwise.alaw, "sign(x) * CASE WHEN abs(x) < 1 / 87.6 THEN 87.6 * abs(x) ELSE 1 + ln(87.6 * abs(x)) END / (1 + ln(87.6))")
each("ialaw", pointwise.ialaw, "sign(x) * CASE WHEN abs(x) < 1 / (1 + ln(87.6)) THEN abs(x) * (1 + ln(87.6)) / 87.6 ELSE exp(abs(x) * (1 + ln(87.6)) - 1) / 87.6 END")
each("ulaw", pointwise.ulaw, "sign(x) * ln(1 + 255 * abs(x)) / ln(256)")
each("iulaw", pointwise.iulaw, "sign(x) * (pow(256, abs(x)) - 1) / 255")
each("quantize", pointwise.quantize, "greatest(0, least(255, floor(x * 128 + 128)))")
each("quantize_mid_tread", lambda x: pointwise.quantize(x, 1, 4, "mid-tread"), "greatest(0, least(14, sign(x * 7.5 + 7) * floor(abs(x * 7.5 + 7) + 0.5)))")
each("dequantize", lambda x: pointwise.dequantize(pointwise.quantize(x)), "greatest(-1, least(1, (greatest(0, least(255, floor(x * 128 + 128))) - 127.5) / 128))")

# --- spectra of frames

BLACKMAN = "(0.42 - 0.5 * cos(2 * pi() * j / 15) + 0.08 * cos(4 * pi() * j / 15))"
STFT = f", {framed(16, 8)}, d AS (SELECT seq, t, k, sum(x * {BLACKMAN} * cos(2 * pi() * j * k / 16)) AS re, -sum(x * {BLACKMAN} * sin(2 * pi() * j * k / 16)) AS im FROM f, {grid('k', 9)} g GROUP BY seq, t, k) "
vectors("stft", lambda df: spectra.stft(df, 16, 8, 16, norm="none", eps=0), STFT + f"SELECT seq, t, k, {y('re * re + im * im', 3)} FROM d", digits=3)


def stft_events(spark, sf_dir):
    """Power spectrum of every frame of every user's event values."""
    found = spectra.stft(fx.w(spark, sf_dir), 16, 8, 16, norm="none", eps=0).select(F.col("seq").alias("user_id"), F.col("t").alias("frame"), F.posexplode("x").alias("bin", "power"))
    return found.select("user_id", "frame", F.col("bin").cast("long").alias("bin"), (F.round("power", 3) + 0.0).alias("power"))


register("stft_events", stft_events, f"WITH {fx.W}{STFT}SELECT seq AS user_id, t AS frame, k AS bin, round(re * re + im * im, 3) + 0.0 AS power FROM d")
samples("istft", lambda df: spectra.istft(spectra.stft(df, 16, 8, 16, window="hanning", out_format="complex"), 16, 8, 16, window="hanning").join(sequences.lengths(df), "seq").filter("n < length"), covered(16, 8, 15))
LAPPED = "sqrt(4.0 / 8) * {0}(pi() / 8 * (k + 0.5) * (j + 0.5 + 4)) * sin(pi() * (j + 0.5) / 16)"
for name, op, wave in (("mdct", spectra.mdct, "cos"), ("mdst", spectra.mdst, "sin")):
    vectors(name, lambda df, op=op: op(df, 16), f", {framed(16, 8, end=' + 8')} SELECT seq, t, k, {y('sum(x * ' + LAPPED.format(wave) + ')', 5)} FROM f, {grid('k', 8)} g GROUP BY seq, t, k", digits=5)
samples("imdct", lambda df: spectra.imdct(spectra.mdct(df, 16), 16).join(sequences.lengths(df), "seq").filter("n < length"), f"SELECT seq, n, {y('x')} FROM w")
samples("imdst", lambda df: spectra.imdst(spectra.mdst(df, 16), 16).join(sequences.lengths(df), "seq").filter("n < length"), f"SELECT seq, n, {y('x')} FROM w")
register("flux", lambda spark, d: fx.plain(sequences.flux(sequences.frame(fx.w(spark, d), 8, 4), reduction="none"), ["seq", "t"], "flux"), (
    f"WITH {fx.W}, {framed(8, 4)} SELECT a.seq, b.t, {y('sqrt(sum((a.x - b.x) * (a.x - b.x)))')} FROM f a JOIN f b ON b.seq = a.seq AND b.t = a.t - 1 AND b.j = a.j GROUP BY a.seq, b.t"
))

# --- filters

TAPS = [0.5, -0.25, 0.125, 0.0625]


def fir_sql(matrix: np.ndarray, ahead: int = 0, hold: bool = False, place: str = "k, ", digits: int = 6) -> str:
    """SQL of y[n] = sum of taps[j] * x[n + ahead - j], the last sample held."""
    at = f"w.n + {ahead} - m.n"
    at = f"least(len - 1, {at})" if hold else at
    return f", {fx.matrix_cte(np.atleast_2d(matrix))} SELECT w.seq, w.n, {place}{y('sum(a * b.x)', digits)} FROM w JOIN s USING (seq) CROSS JOIN m JOIN w b ON b.seq = w.seq AND b.n = {at} GROUP BY w.seq, w.n{', k' if place else ''}"


samples("dfs", lambda df: filters.dfs(df, TAPS), fir_sql(np.array(TAPS), place=""))
POLES = [1.0, -0.9, 0.5]
samples("dfs_truncated", lambda df: filters.dfs(df, [1.0, 0.5], POLES, 24), fir_sql(filters.impulse_response(np.array([1.0, 0.5]), np.array(POLES), 24), place=""))
REPLY = filters.impulse_response(np.array([1.0, 0.5]), np.array(POLES), 400)
samples("dfs_recursive", lambda df: filters.dfs(df, [1.0, 0.5], POLES), fir_sql(REPLY[np.abs(REPLY) > 1e-13], place=""))
SECTION = filters.impulse_response(*[np.array(c) for c in (filters.resonance(8000, 1000, 500), filters.resonance(8000, 2000, 400))], 400)
samples("df2", lambda df: filters.df2(df, 8000, 2000, 400, 1000, 500), fir_sql(np.where(np.abs(SECTION) > 1e-13, SECTION, 0), place=""))
PQMF = spectra.pqmf_filters(4, 15)
vectors("pqmf", lambda df: spectra.pqmf(df, 4, 15), fir_sql(PQMF, 7, True), place="n")
IPQMF = spectra.pqmf_filters(4, 15, synthesis=True)
samples("ipqmf", lambda df: spectra.ipqmf(spectra.pqmf(df, 4, 15), 4, 15), (
    f", {fx.matrix_cte(PQMF, 'm')}, {fx.matrix_cte(IPQMF, 'i')}, "
    "b AS (SELECT w.seq, w.n, k, sum(a * b.x) AS x FROM w JOIN s USING (seq) CROSS JOIN m JOIN w b ON b.seq = w.seq AND b.n = least(len - 1, w.n + 7 - m.n) GROUP BY w.seq, w.n, k) "
    f"SELECT w.seq, w.n, {y('sum(a * b.x)')} FROM w JOIN s USING (seq) CROSS JOIN i JOIN b ON b.seq = w.seq AND b.k = i.k AND b.n = least(len - 1, w.n + 8 - i.n) GROUP BY w.seq, w.n"
))
OBAND = spectra.octave_filters(8000, 500, 1000, 3000, 30)
vectors("oband", lambda df: spectra.oband(df, 8000, 500, 1000, 3000, 30), fir_sql(OBAND[:, ::-1], OBAND.shape[1] - 1 - 15, True), place="n")
#: 1,000 taps: too slow as a join in SQL; documented values and the short query stand for it.
vectors("oband_long", lambda df: spectra.oband(df, 16000), None, place="n")
_, GAMMA_POLES, GAMMA_GAINS = filters.gammatone_design(8000, 500, 1000, 1500)
GAMMA = ",".join(f"({k},{abs(p)!r},{np.angle(p)!r},{g!r})".replace("np.float64(", "").replace("),", ",").replace("))", ")") for k, (p, g) in enumerate(zip(GAMMA_POLES, GAMMA_GAINS, strict=True)))
#: The impulse response of four equal poles: binomials times powers of the pole.
GAMMA_REPLY = "gain * (m + 1) * (m + 2) * (m + 3) / 6 * pow(radius, m) * {0}(angle * m)"
vectors("gammatone", lambda df: filters.gammatone(df, 8000, f_min=500, f_max=1500), (
    f", g AS (SELECT k::BIGINT AS k, radius::DOUBLE AS radius, angle::DOUBLE AS angle, gain::DOUBLE AS gain FROM (VALUES {GAMMA}) v(k, radius, angle, gain)), "
    f"y AS (SELECT a.seq, a.n, k, sum(b.x * {GAMMA_REPLY.format('cos').replace('m', '(a.n - b.n)').replace('(a.n - b.n)ul', 'mul')}) AS re, sum(b.x * {GAMMA_REPLY.format('sin').replace('m', '(a.n - b.n)')}) AS im "
    "FROM w a JOIN w b ON b.seq = a.seq AND b.n <= a.n CROSS JOIN g GROUP BY a.seq, a.n, k) "
    f"SELECT seq, n, k, {y('re')} FROM y UNION ALL SELECT seq, n, k + {len(GAMMA_POLES)} AS k, {y('im')} FROM y"
), place="n")
MOVES, FACTORS = filters.igammatone_design(8000, 1, f_min=500, f_max=1500)
TURNS = ",".join(f"({k},{int(m)},{float(f.real)!r},{float(f.imag)!r})" for k, (m, f) in enumerate(zip(MOVES, FACTORS, strict=True)))
samples("igammatone", lambda df: filters.igammatone(filters.gammatone(df, 8000, f_min=500, f_max=1500), 8000, 1, f_min=500, f_max=1500), (
    f", g AS (SELECT k::BIGINT AS k, radius::DOUBLE AS radius, angle::DOUBLE AS angle, gain::DOUBLE AS gain FROM (VALUES {GAMMA}) v(k, radius, angle, gain)), "
    f"y AS (SELECT a.seq, a.n, k, sum(b.x * {GAMMA_REPLY.format('cos').replace('m', '(a.n - b.n)').replace('(a.n - b.n)ul', 'mul')}) AS re, sum(b.x * {GAMMA_REPLY.format('sin').replace('m', '(a.n - b.n)')}) AS im "
    "FROM w a JOIN w b ON b.seq = a.seq AND b.n <= a.n CROSS JOIN g GROUP BY a.seq, a.n, k), "
    f"f AS (SELECT k::BIGINT AS k, m::BIGINT AS m, re::DOUBLE AS re, im::DOUBLE AS im FROM (VALUES {TURNS}) v(k, m, re, im)) "
    f"SELECT w.seq, w.n, {y('coalesce(sum(y.re * f.re - y.im * f.im), 0)', 5)} FROM w CROSS JOIN f LEFT JOIN y ON y.seq = w.seq AND y.k = f.k AND y.n = w.n - f.m GROUP BY w.seq, w.n"
), digits=5)


def taps(df):
    """A filter for each block of eight samples, from the samples themselves."""
    return sequences.frame(df, 3, 8, center=False).withColumn("x", F.transform("x", lambda v, k: 1.0 + F.sqrt(v) / 50 + k))


FOLLOWED = (
    ", f AS (SELECT s.seq, t, j, 1 + sqrt(coalesce(x, 0)) / 50 + j AS h FROM (SELECT seq, unnest(range((len + 7) // 8)) AS t FROM s) s CROSS JOIN (SELECT unnest(range(3)) AS j) g LEFT JOIN w ON w.seq = s.seq AND w.n = t * 8 + j), "
    "h AS (SELECT w.seq, w.n, a.j, a.h + (coalesce(b.h, a.h) - a.h) * (w.n % 8) / 8 AS h FROM w JOIN f a ON a.seq = w.seq AND a.t = w.n // 8 LEFT JOIN f b ON b.seq = w.seq AND b.t = a.t + 1 AND b.j = a.j) "
)
samples("zerodf", lambda df: filters.zerodf(df, taps(df), 8, taps=3), FOLLOWED + f"SELECT h.seq, h.n, {y('sum(h.h * x)')} FROM h JOIN w ON w.seq = h.seq AND w.n = h.n - h.j GROUP BY h.seq, h.n")


def poles(df):
    """Gain 1 and one pole for each block of eight samples."""
    return sequences.frame(df, 2, 8, center=False).withColumn("x", F.array(F.lit(1.0), F.get("x", F.lit(0)) / -1000))


samples("poledf", lambda df: filters.poledf(df, poles(df), 8, order=1), (
    ", f AS (SELECT s.seq, t, -coalesce(x, 0) / 1000 AS a FROM (SELECT seq, unnest(range((len + 7) // 8)) AS t FROM s) s LEFT JOIN w ON w.seq = s.seq AND w.n = t * 8), "
    "c AS (SELECT w.seq, w.n, w.x, a.a + (coalesce(b.a, a.a) - a.a) * (w.n % 8) / 8 AS a FROM w JOIN f a ON a.seq = w.seq AND a.t = w.n // 8 LEFT JOIN f b ON b.seq = w.seq AND b.t = a.t + 1), "
    "r AS (SELECT seq, n, x AS y FROM c WHERE n = 0 UNION ALL SELECT c.seq, c.n, c.x - c.a * r.y FROM r JOIN c ON c.seq = r.seq AND c.n = r.n + 1) "
    f"SELECT seq, n, {y('y')} FROM r"
), cte="RECURSIVE " + fx.W)


def cepstra(df):
    return sequences.frame(df, 5, 8, center=False).withColumn("x", F.transform("x", lambda v: v / 2000))


#: Taps of each frame from its cepstrum on the warped circle, and the samples through them, drawn from frame to frame.
CEPSTRAL = (
    ", f AS (SELECT s.seq, t, j, {0}coalesce(x, 0) / 2000 AS c FROM (SELECT seq, unnest(range((len + 7) // 8)) AS t FROM s) s CROSS JOIN (SELECT unnest(range(5)) AS j) g LEFT JOIN w ON w.seq = s.seq AND w.n = t * 8 + j), "
    "o AS (SELECT i, 2 * pi() * i / 64 AS o FROM " + grid("i", 64) + " g), p AS (SELECT i, o + 2 * atan2(0.1 * sin(o), 1 - 0.1 * cos(o)) AS p FROM o), "
    "l AS (SELECT seq, t, i, sum(c * cos(j * p)) AS re, -sum(c * sin(j * p)) AS im FROM f CROSS JOIN p GROUP BY seq, t, i), "
    "h AS (SELECT seq, t, k, sum(exp(re) * cos(im + 2 * pi() * i * k / 64)) / 64 AS h FROM l CROSS JOIN (SELECT unnest(range(12)) AS k) g GROUP BY seq, t, k) "
    "SELECT w.seq, w.n, " + y("sum((a.h + (coalesce(b.h, a.h) - a.h) * (w.n % 8) / 8) * q.x)", 5) + " FROM w JOIN h a ON a.seq = w.seq AND a.t = w.n // 8 LEFT JOIN h b ON b.seq = w.seq AND b.t = a.t + 1 AND b.k = a.k JOIN w q ON q.seq = w.seq AND q.n = w.n - a.k GROUP BY w.seq, w.n"
)
samples("mglsadf", lambda df: filters.mglsadf(df, cepstra(df), 8, alpha=0.1, ir_length=12, n_fft=64), CEPSTRAL.format(""), digits=5)
samples("imglsadf", lambda df: filters.imglsadf(df, cepstra(df), 8, alpha=0.1, ir_length=12, n_fft=64), CEPSTRAL.format("-"), digits=5)
samples("mglsadf_stages", lambda df: filters.mglsadf(df, cepstra(df), 8, alpha=0.1, ir_length=12, n_fft=64, mode="multi-stage", taylor_order=6), None)
FALL, RISE = 1 - np.exp(-1000 / 8000), 1 - np.exp(-1000 / (500 * 8000))
STEPPED = f"{{0}} + (CASE WHEN c.g < {{0}} THEN {FALL!r} ELSE {RISE!r} END) * (c.g - {{0}})".replace("np.float64(", "").replace(") ELSE", " ELSE").replace(") END", " END")
samples("drc", lambda df: filters.drc(df, 8000), (
    ", c AS (SELECT seq, n, x, pow(10, least(0, (-20 - 20 * log10(abs(x) + 1e-10)) / 2) / 20) AS g FROM w), "
    f"r AS (SELECT seq, n, x, {STEPPED.format('1.0')} AS y FROM c WHERE n = 0 UNION ALL SELECT c.seq, c.n, c.x, {STEPPED.format('r.y')} FROM r JOIN c ON c.seq = r.seq AND c.n = r.n + 1) "
    f"SELECT seq, n, {y('x * y')} FROM r"
), fx.unit, "RECURSIVE " + fx.UNIT)


def griffin(df):
    return filters.griffin(spectra.stft(df, 16, 4, 16), 16, 4, 16, n_iter=10).join(sequences.lengths(df), "seq").filter("n < length")


samples("griffin", griffin, None)


def pitch(df):
    """Frames of pitch periods: a tenth of the value and two more, 0 where it is 0."""
    return df.select("seq", F.col("n").alias("t"), F.when(F.col("x") > 0, F.col("x") / 10 + 2).otherwise(0.0).alias("x"))


SWEEP = (
    "p AS (SELECT seq, n AS t, CASE WHEN x > 0 THEN x / 10 + 2 ELSE 0 END AS p, lead(CASE WHEN x > 0 THEN x / 10 + 2 ELSE 0 END) OVER (PARTITION BY seq ORDER BY n) AS q FROM w), "
    f"e AS (SELECT seq, t * 4 + i AS n, CASE WHEN p > 0 THEN p + (CASE WHEN q > 0 THEN q ELSE p END - p) * i / 4 END AS p FROM p, {grid('i', 4)} g), "
    "c AS (SELECT seq, n, p, sum(coalesce(1 / p, 0)) OVER (PARTITION BY seq ORDER BY n) AS c FROM e), b AS (SELECT *, coalesce(max(CASE WHEN p IS NULL THEN c END) OVER (PARTITION BY seq ORDER BY n), 0) AS b FROM c)"
)
samples("excite", lambda df: filters.excite(pitch(df), 4, "sawtooth"), f", {SWEEP} SELECT seq, n, {y('CASE WHEN p IS NULL THEN 0 ELSE 2 * (c - b - floor(c - b)) - 1 END')} FROM b", fx.u, fx.U)
samples("excite_pulse", lambda df: filters.excite(pitch(df), 4), (
    f", {SWEEP} SELECT seq, n, {y('CASE WHEN p IS NOT NULL AND ceil(c - b - 1e-9) - ceil(c - b - 1 / p - 1e-9) >= 1 THEN sqrt(p) ELSE 0 END')} FROM b"
), fx.u, fx.U)

# --- scores


def noisy(spark, sf_dir):
    return fx.w(spark, sf_dir).select("seq", "n", F.col("x").alias("s"), (F.col("x") + F.col("n") % 3 - 1).alias("sn"))


register("snr", lambda spark, d: fx.plain(metrics.snr(noisy(spark, d), 8, True, "none"), ["seq", "t"], "snr"), (
    f"WITH {fx.W} SELECT seq, n // 8 AS t, {y('10 * log10((sum(x * x) + 1e-8) / (sum((n % 3 - 1) * (n % 3 - 1)) + 1e-8))')} FROM w GROUP BY seq, n // 8 HAVING count(*) = 8"
))


def tracks(spark, sf_dir):
    return fx.u(spark, sf_dir).select("seq", F.col("n").alias("t"), "x", F.when(F.col("n") % 7 == 0, 0.0).otherwise(F.col("x") + 1).alias("y"))


TRACKS = fx.U + ", p AS (SELECT seq, x, CASE WHEN n % 7 = 0 THEN 0 ELSE x + 1 END AS y FROM w)"
register("f0eval", lambda spark, d: fx.plain(metrics.f0eval(tracks(spark, d)), [], "f0eval"), f"WITH {TRACKS} SELECT {y('sqrt(avg(pow(1200 * log2(x) - 1200 * log2(y), 2)))')} FROM p WHERE x <> 0 AND y <> 0")
SCORE = "coalesce(2 * sum(CASE WHEN {0} THEN 1 ELSE 0 END) / nullif(2 * sum(CASE WHEN {0} THEN 1 ELSE 0 END) + sum(CASE WHEN (x = 0) <> (y = 0) THEN 1 ELSE 0 END), 0), 0)"
register("f0eval_f1", lambda spark, d: fx.plain(metrics.f0eval(tracks(spark, d), "none", "vuv-macro-f1-score"), ["seq"], "f0eval"), (
    f"WITH {TRACKS} SELECT seq, {y('(' + SCORE.format('x <> 0 AND y <> 0') + ' + ' + SCORE.format('x = 0 AND y = 0') + ') / 2')} FROM p GROUP BY seq"
))

# --- voice


def loudness(df):
    """Samples between -1 and 1."""
    return df.withColumn("x", (F.col("x") - 250) / 250)


def tones(df):
    """A pitch of 400 Hz for every tenth sample, 0 for every third of those."""
    return df.filter("n % 10 = 0").select("seq", (F.col("n") / 10).cast("long").alias("t"), F.when(F.col("n") % 3 == 0, 0.0).otherwise(400.0).alias("x"))


def constant_q(spark, sf_dir):
    found = voice.cqt(fx.w(spark, sf_dir), 8, 8000, 1000, 8, 4)
    return found.select("seq", "t", F.col("k").cast("long").alias("k"), (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


CENTRES, LENGTHS, KERNELS = voice.constant_q(8000, 1000, 8, 4, 0, 1, 1, "hann")
KERNEL = ",".join(f"({k},{j + int(np.floor(-LENGTHS[k] / 2))},{float(v.real * np.sqrt(LENGTHS[k]))!r},{float(-v.imag * np.sqrt(LENGTHS[k]))!r})" for k, h in enumerate(KERNELS) for j, v in enumerate(h))
register("cqt", constant_q, (
    f"WITH {fx.W}, h AS (SELECT k::BIGINT AS k, j::BIGINT AS j, re::DOUBLE AS re, im::DOUBLE AS im FROM (VALUES {KERNEL}) v(k, j, re, im)) "
    "SELECT p.seq, p.t, h.k, round(sum(coalesce(x, 0) * re), 5) + 0.0 AS re, round(sum(coalesce(x, 0) * im), 5) + 0.0 AS im "
    "FROM (SELECT seq, unnest(range((len + 7) // 8)) AS t FROM s) p CROSS JOIN h LEFT JOIN w ON w.seq = p.seq AND w.n = p.t * 8 + h.j GROUP BY p.seq, p.t, h.k"
))
EVEN = ",".join(f"({k},{float(2 * v / n)!r})" for k, (v, n) in enumerate(zip(voice.flat_response(CENTRES, LENGTHS, KERNELS, 8000, 2), LENGTHS, strict=True)))
samples("icqt", lambda df: voice.icqt(voice.cqt(df, 2, 8000, 1000, 8, 4), 2, 8000, None, 1000, 8, 4).join(sequences.lengths(df), "seq").filter("n < length"), (
    f", h AS (SELECT k::BIGINT AS k, j::BIGINT AS j, re::DOUBLE AS re, im::DOUBLE AS im FROM (VALUES {KERNEL}) v(k, j, re, im)), e AS (SELECT k::BIGINT AS k, e::DOUBLE AS e FROM (VALUES {EVEN}) v(k, e)), "
    "c AS (SELECT p.seq, p.t, h.k, sum(coalesce(x, 0) * re) AS re, sum(coalesce(x, 0) * im) AS im FROM (SELECT seq, unnest(range((len + 1) // 2)) AS t FROM s) p CROSS JOIN h LEFT JOIN w ON w.seq = p.seq AND w.n = p.t * 2 + h.j GROUP BY p.seq, p.t, h.k), "
    "q AS (SELECT seq, t * 2 + j AS n, sum(e * (c.re * h.re + c.im * h.im)) AS x FROM c JOIN h USING (k) JOIN e USING (k) GROUP BY seq, t * 2 + j) "
    f"SELECT w.seq, w.n, {y('q.x', 5)} FROM w JOIN q ON q.seq = w.seq AND q.n = w.n"
), digits=5)
register("pitch", lambda spark, d: fx.plain(voice.pitch(loudness(fx.w(spark, d)), 10, 8000, 400, 1600), ["seq", "t"]))
vectors("pitch_spec", lambda df: voice.pitch_spec(loudness(df), tones(df), 10, 8000, 128), None)
vectors("ap_group_delay", lambda df: delayband.ap_group_delay(loudness(df), tones(df), 10, 16000, 64), None)
vectors("ap", lambda df: voice.ap(loudness(df), tones(df), 10, 8000, 64, f_min=300), None)


def world_synth(df):
    f0 = tones(df)
    shape = lambda value: f0.select("seq", "t", F.array(*[F.lit(value)] * 33).alias("x"))
    return voice.world_synth(f0, shape(0.01), shape(1.0), 10, 8000, 64)


samples("world_synth", world_synth, None)

# --- generators


def generator(name: str, make, expression: str, count: int) -> None:
    register(name, lambda spark, d: fx.plain(make(spark), ["n"]), f"SELECT n, {y(expression)} FROM {grid('n', count)} g")


generator("impulse", lambda spark: src.impulse(spark, 99), "CASE WHEN n = 0 THEN 1 ELSE 0 END", 100)
generator("step", lambda spark: src.step(spark, 99, 2.0), "2 + 0 * n", 100)
generator("ramp", lambda spark: src.ramp(spark, 1, 50, 0.5), "1 + n * 0.5", 99)
generator("sin", lambda spark: src.sin(spark, 99, 10, 3.0), f"3 * sin(2 * {PI} * n / 10)", 100)
generator("train", lambda spark: src.train(spark, 99, 5), "CASE WHEN n % 5 = 0 THEN sqrt(5) ELSE 0 END", 100)
SHIFTED = "((r >> 1) & 2147483647) | ((xor(r >> 1, r >> 29) & 1) << 31)"
register("mseq", lambda spark, d: fx.plain(src.mseq(spark, 99), ["n"]), (
    f"WITH RECURSIVE q AS (SELECT 0::BIGINT AS n, {SHIFTED} AS r FROM (SELECT 1431655765::BIGINT AS r) z UNION ALL SELECT n + 1, {SHIFTED} FROM q WHERE n < 99) SELECT n, {y('CASE WHEN (r & 1) = 1 THEN 1 ELSE -1 END')} FROM q"
))
UNIFORM = "((('0x' || substr(md5('1:{0}:' || n), 1, 12))::BIGINT + 0.5) / 281474976710656)"
register("nrand", lambda spark, d: fx.plain(src.nrand(spark, 999, seed=1), ["n"]), f"SELECT n, {y(f'sqrt(-2 * ln({UNIFORM.format(1)})) * cos(2 * {PI} * {UNIFORM.format(2)})')} FROM {grid('n', 1000)} g")
register("rand", lambda spark, d: fx.plain(src.rand(spark, 999, seed=1), ["n"]), f"SELECT n, {y(UNIFORM.format(0))} FROM {grid('n', 1000)} g")
register("mseq_like", lambda spark, d: fx.plain(src.mseq_like(fx.w(spark, d)), ["seq", "n"]), (
    f"WITH RECURSIVE {fx.W}, e AS (SELECT max(len) AS most FROM s), q AS (SELECT 0::BIGINT AS n, {SHIFTED} AS r FROM (SELECT 1431655765::BIGINT AS r) z UNION ALL SELECT n + 1, {SHIFTED} FROM q, e WHERE n + 1 < most) "
    f"SELECT w.seq, n, {y('CASE WHEN (r & 1) = 1 THEN 1 ELSE -1 END')} FROM w JOIN q USING (n)"
))
