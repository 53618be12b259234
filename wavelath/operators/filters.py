"""Digital filters along sequences, fixed and time-varying, and excitation.

Filters of finite length work in blocks with a halo (blocks.py). A recurrence is
run in each block from a state of zero; a block's last state is then a linear
function of its first, so that the states at all block edges follow from one small
row for each block, and a second pass runs every block from its own state. So the
blocks of one sequence are spread over tasks. The compressor is not linear, but its
last gain rises with its first one along a chain of lines, which takes the matrix's
place.

Null samples count as zeros. Places missing in n count as zeros too, and get an
output where their block holds a sample.

Coefficients of a frame stand at its first sample; between frames they are drawn
along a line, and after the last one they are held to the end of its period.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.columns import batched, numbers, require
from . import blocks
from . import sequences as seq
from .prediction import convert_cepstrum


def along(rows: DataFrame, columns: list[str], start: Callable, step: Callable, width: int = 0) -> DataFrame:
    """(seq, n, x): step(state, *columns of a stretch) -> (values, state) over each sequence in order of n; width: values are vectors.

    A sequence passes through one task, a batch at a time.
    """

    def run(batches):
        here, state = None, None
        for batch in batches:
            ids = batch.column("seq").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            values = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if here is None or ids[a] != here:
                    here, state = ids[a], start()
                given = []
                for name in columns:
                    part = batch.column(name).slice(a, b - a)
                    flat = part.flatten() if pa.types.is_list(part.type) else part
                    given.append(flat.to_numpy(zero_copy_only=False).astype(float).reshape((b - a, -1) if flat is not part else b - a))
                got, state = step(state, *given)
                values.append(got)
            out = np.concatenate(values)
            x = pa.array(out) if not width else pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(out).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("n"), x], ["seq", "n", "x"])

    kind = rows.schema["seq"].dataType.simpleString()
    ordered = rows.select("seq", F.col("n").cast("long").alias("n"), *columns).repartition("seq").sortWithinPartitions("seq", "n")
    return ordered.mapInArrow(run, f"seq {kind}, n long, x {'array<double>' if width else 'double'}")


def responses(a: np.ndarray, size: int) -> np.ndarray:
    """What size samples of a recurrence are for a unit in each of its last outputs (columns), and for a unit input (last column)."""
    order = len(a) - 1
    past = np.zeros((order + size, order + 1), a.dtype)
    past[:order, :order] = np.eye(order)
    for n in range(order, order + size):
        for k in range(1, order + 1):
            past[n] -= a[k] * past[n - k]
        past[n, order] += n == order
    return past[order:]


def recurrence(b: np.ndarray, a: np.ndarray, block: int = 512) -> tuple[Callable, Callable]:
    """start and step of y[n] = sum b[k] x[n-k] - sum a[k] y[n-k], a block of samples at a time."""
    reply = responses(a, block)
    order = len(a) - 1
    kind = np.result_type(a, b, float)

    def start():
        return np.zeros(len(b) - 1), np.zeros(order, kind)

    def step(state, x):
        before, last = state
        out = np.empty(len(x), kind)
        for at in range(0, len(x), block):
            part = np.concatenate([before, x[at : at + block]])
            size = len(part) - len(before)
            driven = np.convolve(part, b)[len(before) : len(before) + size]
            y = np.convolve(driven, reply[:size, order])[:size]
            if order:
                y = y + reply[:size, :order] @ last
                last = np.concatenate([last, y])[-order:]
            before = part[len(part) - len(before) :]
            out[at : at + size] = y
        return out, (before, last)

    return start, step


def impulse_response(b: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    start, step = recurrence(b, a)
    return step(start(), np.eye(1, size)[0])[0]


def coefficients(b, a) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and monic denominator; element 0 of a is the gain."""
    b = np.ones(1) if b is None else np.asarray(b, float)
    a = np.ones(1) if a is None else np.asarray(a, float)
    return b * a[0], np.concatenate([[1.0], a[1:]])


def recursive(samples: DataFrame, history: int, run: Callable, width: int, vectors: bool = False, frames: DataFrame | None = None, period: int = 1, frame_size: int = 0, matrix: np.ndarray | None = None) -> DataFrame:
    """(seq, n, x) of a linear recurrence in blocks.

    run(block, state) -> (values, last state, and for a state of None also the matrix that takes a first state to the last
    one). States are width numbers; None is a state of zero. history is how many samples before a block it looks at. Where
    that matrix is the same for all blocks it is given here, and rows carry states alone.
    """
    size = blocks.SIZE
    sent, still = blocks.sent(samples, history, 0, size), frames is None
    if not still:
        framed = blocks.sent_vectors(frames, F.col("t") * period, period, period, size)

    def with_frames_(rows: DataFrame) -> DataFrame:
        return rows if frames is None else rows.unionByName(framed, allowMissingColumns=True)

    def last_state(block: blocks.Block):
        if not block.count:
            return None
        _, state, own = run(block, None)
        return np.array([block.number]), (state if matrix is not None else np.concatenate([state, own.reshape(-1)]))[None]

    # the last block of a sequence hands nothing on; where a sequence is one block, nothing is to be done here
    open_ = sent.filter(f"block < floor((length - 1) / {size})")
    if frames is None:
        ends = blocks.work(open_, last_state, size, vectors=True)
    else:
        wanted = blocks.joined(framed, open_.select("seq", "block").distinct(), ["seq", "block"])
        ends = blocks.work(open_.unionByName(wanted, allowMissingColumns=True), last_state, size, vectors=True)

    def carry(state, number, own):
        """The first state of each block, from the last state and the matrix of each block before it."""
        out = np.zeros((len(own), width))
        for k in range(len(own)):
            before, held, last = state
            if before is not None and number[k] != before + 1:  # blocks without a sample lie between; with frames they have no output
                held = np.linalg.matrix_power(last, int(number[k] - before - 1)) @ held if still else np.zeros(width)
            last = own[k, width:].reshape(width, width) if matrix is None else matrix
            out[k], state = held, (number[k], own[k, :width] + last @ held, last)
        return out, state

    # the last block is told its first state too, and hands on nothing
    lasts = sent.filter(f"block > 0 AND block = floor((length - 1) / {size})").select("seq", "block").distinct().select("seq", F.col("block").alias("n"), F.array_repeat(F.lit(0.0), width * (width + 1) if matrix is None else width).alias("x"))
    states = along(ends.unionByName(lasts).withColumn("number", F.col("n")), ["number", "x"], lambda: (None, np.zeros(width), None), carry, width=width)
    first = states.filter("n > 0").select("seq", F.col("n").alias("block"), F.lit(-1).cast("long").alias("n"), F.col("x").alias("v"))
    if frames is not None:  # states and frames stand in one column of vectors, as long as frames are
        first = first.withColumn("v", F.concat("v", numbers([0.0] * (frame_size - width))))

    def whole(block: blocks.Block):
        if not block.count:
            return None
        state = None
        if block.numbers.size and block.numbers[0] == -1:
            state, block.vectors, block.numbers = block.vectors[0][:width], block.vectors[1:], block.numbers[1:]
        return np.arange(block.begin, block.begin + block.count), run(block, np.zeros(width) if state is None else state)[0]

    return blocks.work(with_frames_(sent).unionByName(first, allowMissingColumns=True), whole, size, vectors)


def constant(channels: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """history, run, width and matrix of recurrences with constant coefficients for recursive(); several channels, complex ones too, are worked on side by side."""
    kernels = [recurrence(num, den) for num, den in channels]
    orders = [len(den) - 1 for _, den in channels]
    history = max(len(num) - 1 for num, _ in channels)
    edges = np.cumsum([0, *orders])
    split = any(np.iscomplexobj(a) or np.iscomplexobj(b) for b, a in channels)
    width = int(edges[-1]) * (2 if split else 1)

    def packed(z: np.ndarray) -> np.ndarray:
        return np.concatenate([z.real, z.imag]) if split else z

    matrix = np.zeros((width, width))
    for (num, _), (_, step), order, at in zip(channels, kernels, orders, edges, strict=False):
        for k in range(order):
            _, (_, last) = step((np.zeros(len(num) - 1), np.eye(order)[k]), np.zeros(blocks.SIZE))
            columns = np.zeros(int(edges[-1]), complex if split else float)
            columns[at : at + order] = last
            matrix[:, at + k] = packed(columns)
            if split:
                matrix[:, edges[-1] + at + k] = packed(1j * columns)

    def run(block: blocks.Block, state):
        x = block.values(history)
        z = np.zeros(int(edges[-1]), complex) if state is None else state[: edges[-1]] + 1j * state[edges[-1] :] if split else state
        out, last = [], []
        for (num, _), (_, step), a, b in zip(channels, kernels, edges[:-1], edges[1:], strict=True):
            y, (_, end) = step((x[history - len(num) + 1 : history], z[a:b] if split else z[a:b].real), x[history:])
            out.append(y)
            last.append(end)
        y = np.stack(out, axis=1)
        y = np.concatenate([y.real, y.imag], axis=1) if split else y[:, 0]
        return y, packed(np.concatenate(last)), matrix

    return {"history": history, "run": run, "width": width, "matrix": matrix}


def dfs(samples: DataFrame, b=None, a=None, ir_length: int | None = None) -> DataFrame:
    """A filter b / a; without a denominator, or cut to an impulse response of ir_length, it is of finite length."""
    num, den = coefficients(b, a)
    if ir_length is not None:
        return seq.fir(samples, impulse_response(num, den, ir_length))
    if len(den) == 1:
        return seq.fir(samples, num)
    return recursive(samples, **constant([(num, den)]))


def resonance(sample_rate: float, frequency: float | None, bandwidth: float | None):
    if frequency is None:
        return None
    radius = math.exp(-math.pi * bandwidth / sample_rate)
    return [1.0, -2 * radius * math.cos(2 * math.pi * frequency / sample_rate), radius * radius]


def df2(samples: DataFrame, sample_rate: float, pole_frequency: float | None = None, pole_bandwidth: float | None = None, zero_frequency: float | None = None, zero_bandwidth: float | None = None, ir_length: int | None = None) -> DataFrame:
    """A second-order section by the frequency and bandwidth of its pole and of its zero."""
    return dfs(samples, resonance(sample_rate, zero_frequency, zero_bandwidth), resonance(sample_rate, pole_frequency, pole_bandwidth), ir_length)


def with_frames(rows: DataFrame, frames: DataFrame, frame_period: int) -> DataFrame:
    """rows (seq, n, ...) with the vectors of the frames before and after them (here, after), and how far between (share)."""
    after = frames.select("seq", (F.col("t") - 1).alias("t"), F.col("x").alias("after"))
    both = frames.select("seq", "t", F.col("x").alias("here"))
    both = blocks.joined(both, after, ["seq", "t"], "left").withColumn("after", F.coalesce("after", "here"))
    placed = rows.withColumn("t", F.floor(F.col("n") / F.lit(frame_period)).cast("long")).withColumn("share", (F.col("n") % frame_period) / F.lit(float(frame_period)))
    return blocks.joined(placed, both, ["seq", "t"])


def between(here: np.ndarray, after: np.ndarray, share: np.ndarray) -> np.ndarray:
    return here + (after - here) * share[:, None]


def followed(samples: DataFrame, frames: DataFrame, frame_period: int, left: int, right: int, run: Callable) -> DataFrame:
    """(seq, n, x) of run(values, coefficients) in blocks: samples, and the coefficients of each of their places, from left places before a block to right behind it. It returns a value for each place of the block. Places without a frame have no output."""
    size = max(blocks.SIZE, left + right)
    rows = blocks.sent(samples, left, right, size).unionByName(blocks.sent_vectors(frames, F.col("t") * frame_period, left + frame_period, right + frame_period, size), allowMissingColumns=True)

    def whole(block: blocks.Block):
        if not block.count or block.vectors is None:
            return None
        h, known = block.between_frames(left, right, frame_period)
        own = known[left : left + block.count]
        return np.arange(block.begin, block.begin + block.count)[own], run(block.values(left, right), h)[own]

    return blocks.work(rows, whole, size)


def varying(x: np.ndarray, h: np.ndarray, before: int) -> np.ndarray:
    """y[n] = sum of h[n, k] * x[n + before - k], places outside counted as zeros; x and h begin at the same place."""
    taps = h.shape[1]
    wide = np.concatenate([np.zeros(taps - 1 - before), x, np.zeros(before)])
    return np.einsum("nk,nk->n", np.lib.stride_tricks.sliding_window_view(wide, taps), h[:, ::-1])


def zerodf(samples: DataFrame, frames: DataFrame, frame_period: int, ignore_gain: bool = False, zeroth_index: int = 0, taps: int | None = None) -> DataFrame:
    """Finite filters whose taps (seq, t, x) follow the frames; zeroth_index is the tap of the present sample.

    taps is the largest number of taps, which sets the halo of a block; without it, a block sees as much of its neighbours
    as a block is long, and longer filters are an error.
    """
    left = blocks.SIZE // 2 if taps is None else max(taps - 1 - zeroth_index, 0)

    def run(x, h):
        require(more_taps_than_a_block_can_see=h.shape[1] - 1 - zeroth_index <= left)
        gain = h[:, [zeroth_index]]
        y = varying(x, h / np.where(h.any(axis=1, keepdims=True), gain, 1) if ignore_gain else h, zeroth_index)
        return y[left : len(y) - zeroth_index]

    return followed(samples, frames, frame_period, left, zeroth_index, run)


def poledf(samples: DataFrame, frames: DataFrame, frame_period: int, ignore_gain: bool = False, order: int | None = None) -> DataFrame:
    """All-pole filters that follow the frames (gain, then coefficients). Places without a frame have no output.

    order is the number of coefficients behind the gain; without it, it is looked up in one frame.
    """
    if order is None:
        first = frames.filter("x IS NOT NULL").select(F.size("x")).limit(1).first()
        order = first[0] - 1 if first else 0
    if order < 1:
        return followed(samples, frames, frame_period, 0, 0, lambda x, h: x if ignore_gain else x * h[:, 0])

    def run(block: blocks.Block, state):
        if block.vectors is None or not len(block.vectors):
            return np.full(block.count, np.nan), np.zeros(order), np.zeros((order, order))
        a, known = block.between_frames(0, 0, frame_period)
        x = block.values() if ignore_gain else block.values() * a[:, 0]
        columns = 1 if state is not None else order + 1
        past = np.zeros((order + block.count, columns))  # outputs, oldest first; for a state of None also those of unit states
        if state is None:
            past[:order, 1:] = np.eye(order)
        else:
            past[:order, 0] = state
        back = -a[:, :0:-1]
        for n in range(block.count):
            past[order + n] = back[n] @ past[n : n + order]
            past[order + n, 0] += x[n]
        return np.where(known, past[order:, 0], np.nan), past[-order:, 0], past[-order:, 1:]

    return recursive(samples, 0, run, order, frames=frames, period=frame_period, frame_size=order + 1).filter("x IS NOT NULL")


PHASES = ("minimum", "maximum", "zero")
#: One more, for coefficients of both signs of time: c[-M], ..., c[0], ..., c[M].
TWO_SIDED = "mixed"


def log_responses(mc: np.ndarray, alpha: float, gamma: float, phase: str, n_fft: int, ignore_gain: bool) -> np.ndarray:
    """Logarithms of the responses of mel-generalised cepstra, on half the circle."""

    def half(c: np.ndarray) -> np.ndarray:
        c = convert_cepstrum(c, n_fft // 2, gamma, 0.0, -alpha, False, False, False, False, n_fft)
        if ignore_gain:
            c[:, 0] = 0
        return np.fft.rfft(c, n_fft)

    if phase != TWO_SIDED:
        log_h = half(mc)
        return log_h if phase == "minimum" else log_h.conj() if phase == "maximum" else log_h.real
    require(mixed_phase_needs_an_odd_number_of_coefficients=mc.shape[1] % 2 == 1)
    middle = mc.shape[1] // 2
    behind = mc[:, middle::-1].copy()
    behind[:, 0] = 0
    return half(mc[:, middle:]) + half(behind).conj()


def cepstral_taps(frames: DataFrame, alpha: float, gamma: float, phase: str, ir_length: int, n_fft: int, ignore_gain: bool) -> DataFrame:
    """Frames of mel-generalised cepstra as impulse responses: from the present sample on, up to it, or to both sides of it."""

    def run(mc: np.ndarray) -> np.ndarray:
        h = np.fft.irfft(np.exp(log_responses(mc, alpha, gamma, phase, n_fft, ignore_gain)), n_fft)
        first = 0 if phase == "minimum" else 1 - ir_length
        return np.take(h, np.arange(first, 1 if phase == "maximum" else ir_length) % n_fft, axis=1)

    return frames.select("seq", "t", batched(run, "x").alias("x"))


def on_spectra(samples, frames, frame_period, alpha, gamma, ignore_gain, phase, frame_length, n_fft) -> DataFrame:
    """Short-time spectra times the frames' responses, and back by overlap and add."""
    weights = bases.window_values(frame_length, "hanning", symmetric=False)

    def run(x: np.ndarray, mc: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(x * weights, n_fft) * np.exp(log_responses(mc, alpha, gamma, phase, n_fft, ignore_gain)), n_fft)

    both = seq.frame(samples, frame_length, frame_period).join(frames.select("seq", "t", F.col("x").alias("mc")), ["seq", "t"])
    out = both.select("seq", "t", F.posexplode(batched(run, "x", "mc")).alias("j", "x"))
    # what comes before the frame stands at the end of the transform
    late = F.when(F.col("j") >= (n_fft + frame_length) // 2, F.col("j") - n_fft).otherwise(F.col("j"))
    added = out.select("seq", (F.col("t") * frame_period + late - frame_length // 2).cast("long").alias("n"), "x").groupBy("seq", "n").agg(F.sum("x").alias("x"))
    total = float(weights.sum()) / frame_period
    return blocks.joined(added, seq.lengths(samples), ["seq"]).filter("n >= 0 AND n < length").select("seq", "n", (F.col("x") / total).alias("x"))


def pade(order: int) -> np.ndarray:
    """Coefficients of the numerator of the rational approximation of exp; those of the denominator have alternating signs."""
    return np.array([math.comb(order, k) * math.factorial(2 * order - k) / math.factorial(2 * order) for k in range(order + 1)])


def rational(samples: DataFrame, kernels: DataFrame, frame_period: int, order: int) -> DataFrame:
    """(seq, n, x) through exp(F) as a ratio of polynomials of the strictly causal filter F; kernels: log gain, then F's taps from the last sample on.

    The output comes back into the filter, so a sequence passes through a task in order, as a stream.
    """
    weight = pade(order)
    signs = weight * (-1.0) ** np.arange(order + 1)

    def step(past, x, here, after, share):
        h = between(here, after, share)
        taps = h[:, 1:]
        # powers 0 to order - 1 of F on input and output, the newest sample first
        past = np.zeros((2 * order, taps.shape[1])) if past is None else past
        out = np.empty(len(x))
        for n in range(len(x)):
            power = past @ taps[n]
            y = weight[0] * x[n] + weight[1:] @ power[:order] - signs[1:] @ power[order:]
            past[:, 1:] = past[:, :-1]
            past[1:order, 0], past[order + 1 :, 0] = power[: order - 1], power[order:-1]
            past[0, 0], past[order, 0] = x[n], y
            out[n] = y * math.exp(h[n, 0])
        return out, past

    rows = with_frames(samples.select("seq", "n", F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0)).alias("x")), kernels, frame_period)
    return along(rows, ["x", "here", "after", "share"], lambda: None, step)


def mglsadf(
    samples: DataFrame, frames: DataFrame, frame_period: int, alpha: float = 0, gamma: float = 0, c: int | None = None, ignore_gain: bool = False, phase: str = "minimum",
    mode: str = "single-stage", ir_length: int = 100, n_fft: int = 512, taylor_order: int = 20, frame_length: int | None = None, pade_order: int = 5,
) -> DataFrame:
    """Synthesis by mel-generalised cepstra that follow the frames: as impulse responses (single-stage), by the exponential series
    (multi-stage), on short-time spectra of frame_length, four periods by default (freq-domain), or as a ratio of polynomials of
    pade_order (pade-approx, minimum phase only). phase is minimum, maximum, zero, or mixed for coefficients of both signs of time."""
    gamma = -1 / c if c else gamma
    require(phase_is_known=phase in (*PHASES, TWO_SIDED), mode_is_known=mode in ("single-stage", "multi-stage", "freq-domain", "pade-approx"))
    require(the_rational_mode_has_minimum_phase=mode != "pade-approx" or phase == "minimum", pade_order_is_positive=pade_order > 0)
    if mode == "freq-domain":
        return on_spectra(samples, frames, frame_period, alpha, gamma, ignore_gain, phase, frame_length or 4 * frame_period, n_fft)
    before = 0 if phase == "minimum" else ir_length - 1
    if mode == "single-stage":
        taps = cepstral_taps(frames, alpha, gamma, phase, ir_length, n_fft, ignore_gain)
        return zerodf(samples, taps, frame_period, zeroth_index=before, taps=ir_length if phase in ("minimum", "maximum") else 2 * ir_length - 1)

    def run(mc: np.ndarray) -> np.ndarray:
        c = np.fft.irfft(log_responses(mc, alpha, gamma, phase, n_fft, ignore_gain), n_fft)  # of the plain cepstrum, both signs of time
        places = np.arange(-before, 1 if phase == "maximum" else ir_length)
        return np.column_stack([c[:, 0], np.where(places == 0, 0.0, np.take(c, places % n_fft, axis=1))])

    kernels = frames.select("seq", "t", batched(run, "x").alias("x"))
    if mode == "pade-approx":
        return rational(samples, kernels.withColumn("x", F.concat(F.slice("x", 1, 1), F.slice("x", F.lit(3), F.size("x") - 2))), frame_period, pade_order)
    behind = ir_length - 1 if phase != "maximum" else 0

    def stages(x, h):  # nested: each stage filters the one before, over a halo that holds them all
        total = x
        for k in range(taylor_order, 0, -1):
            total = x + varying(total, h[:, 1:], before) / k
        y = total * np.exp(h[:, 0])
        return y[taylor_order * behind : len(y) - taylor_order * before]

    return followed(samples, kernels, frame_period, taylor_order * behind, taylor_order * before, stages)


def imglsadf(samples: DataFrame, frames: DataFrame, frame_period: int, **kwargs) -> DataFrame:
    """The inverse of mglsadf: the cepstra change sign."""
    return mglsadf(samples, frames.withColumn("x", F.transform("x", lambda v: -v)), frame_period, **kwargs)


VOICED = ("pulse", "harmonic-pulse", "sinusoidal", "sawtooth", "inverted-sawtooth", "triangle", "square")


def excite(pitch: DataFrame, frame_period: int, voiced_region: str = "pulse", unvoiced_region: str = "zeros", polarity: str = "auto", init_phase: float = 0.0, seed: int = 0) -> DataFrame:
    """(seq, n, x) of pitch periods (seq, t, x) in samples, 0 where unvoiced.

    The phase is a running sum of 1 / period that begins anew with each voiced stretch. unvoiced_region is zeros,
    gauss, uniform or m-sequence (random signs); random numbers are a function of seed, seq and n.
    """
    require(voiced_region_is_known=voiced_region in VOICED, polarity_is_known=polarity in ("auto", "unipolar", "bipolar"))
    before = pitch.select("seq", (F.col("t") + 1).alias("t"), F.col("x").alias("before"))
    after = pitch.select("seq", (F.col("t") - 1).alias("t"), F.col("x").alias("after"))
    frames = blocks.joined(blocks.joined(pitch, before, ["seq", "t"], "left"), after, ["seq", "t"], "left")
    # a voiced stretch is drawn out to its end at its last period
    end = F.when(F.col("after") > 0, F.col("after")).otherwise(F.col("x"))
    samples = frames.select("seq", "t", "x", end.alias("end"), F.explode(F.sequence(F.lit(0), F.lit(frame_period - 1))).alias("i"))
    voiced = F.col("x") > 0
    period = F.when(voiced, F.col("x") + (F.col("end") - F.col("x")) * F.col("i") / F.lit(float(frame_period)))
    rows = samples.select("seq", (F.col("t") * frame_period + F.col("i")).cast("long").alias("n"), period.alias("period"))
    summed = seq.running_sum(rows, F.coalesce(1 / F.col("period"), F.lit(0.0)), "sum")
    marked = seq.carried(summed, F.when(F.col("period").isNull(), F.col("sum")), "base")
    phase = F.col("sum") - F.coalesce("base", F.lit(0.0)) + init_phase / (2 * math.pi)
    bipolar = polarity == "bipolar" or polarity == "auto" and voiced_region != "pulse"
    turn = phase - F.floor(phase)
    if voiced_region == "pulse":
        # a pulse where the phase passes a whole number; the stretch begins with one
        ahead = phase - 1 / F.col("period")
        passed = F.ceil(phase - 1e-9) - F.ceil(ahead - 1e-9) >= 1
        sign = F.when(bipolar & (F.pmod(F.ceil(ahead - 1e-9), F.lit(2)) == 1), -1.0).otherwise(1.0)
        wave = F.when(passed, F.sqrt("period") * sign).otherwise(0.0)
    elif voiced_region == "harmonic-pulse":
        # all harmonics below half the sample rate, summed in closed form, at the energy of a pulse
        ahead = phase - 1 / F.col("period")
        count, half = F.floor(F.col("period") / 2), math.pi * ahead
        below = 2 * F.sin(half)
        upper = (2 * count + 1) * half
        flat = F.abs(below) < 1e-6
        safe = F.when(flat, 1.0).otherwise(below)
        waves = F.when(flat, 0.0).otherwise((F.cos(half) - F.cos(upper)) / safe) if bipolar else F.when(flat, count.cast("double")).otherwise((F.sin(upper) - F.sin(half)) / safe)
        wave = waves * F.sqrt(2 / F.greatest(count, F.lit(1)))
    else:
        hat = lambda shift: F.abs(2 * (phase + shift - F.floor(phase + shift)) - 1)
        wave = {
            "sinusoidal": F.sin(2 * math.pi * phase) if bipolar else 0.5 * (1 - F.cos(2 * math.pi * phase)),
            "sawtooth": 2 * turn - 1 if bipolar else turn,
            "inverted-sawtooth": 1 - 2 * turn if bipolar else 1 - turn,
            "triangle": 2 * hat(0.75) - 1 if bipolar else hat(0.5),
            "square": F.when(turn <= 0.5, 1.0).otherwise(-1.0 if bipolar else 0.0),
        }[voiced_region]
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "seq", "n"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    noise = {
        "zeros": F.lit(0.0), "gauss": F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2)),
        "uniform": (2 * uniform(1) - 1) * math.sqrt(3), "m-sequence": F.when(uniform(1) < 0.5, -1.0).otherwise(1.0),
    }[unvoiced_region]
    return marked.select("seq", "n", F.when(F.col("period").isNull(), noise).otherwise(wave).alias("x"))


# --- gammatone


#: Bandwidth at 0 Hz and quality of the auditory filters' equivalent rectangular bandwidth.
ERB_BASE, ERB_QUALITY = 24.7, 9.265


def gammatone_design(sample_rate: float, f_min: float = 70, f_ref: float = 1000, f_max: float = 6700, filter_order: int = 4, bandwidth_factor: float = 1, density: float = 1):
    """Centre frequencies in equal steps of equivalent rectangular bandwidth through f_ref, their complex poles, and gains of 0 dB at the centres."""
    corner = ERB_BASE * ERB_QUALITY
    f_min, f_ref, f_max = (ERB_QUALITY * math.log((f + corner) / corner) for f in (f_min, f_ref, f_max))  # on the axis of bandwidths
    below, above = math.floor((f_ref - f_min) * density), math.ceil((f_max + 1e-6 - f_ref) * density)
    places = f_ref + np.arange(-below, above) / density
    centre = corner * (np.exp(places / ERB_QUALITY) - 1)
    width = (corner + centre) / ERB_QUALITY * bandwidth_factor
    # a chain of n one-pole filters of unit decay has this equivalent rectangular bandwidth
    chain = math.pi * math.comb(2 * filter_order - 2, filter_order - 1) / 4.0 ** (filter_order - 1)
    poles = np.exp(2 * math.pi / sample_rate * (1j * centre - width / chain))
    return centre, poles, 2 * (1 - np.abs(poles)) ** filter_order


def gammatone_filters(sample_rate: float, exact: bool = False, **design) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Centre frequencies, and numerator and denominator of each channel.

    A channel is a chain of equal one-pole filters; exact samples the envelope n**(order - 1) * pole**n itself, whose
    numerator has Eulerian numbers.
    """
    order = design.get("filter_order", 4)
    centre, poles, gains = gammatone_design(sample_rate, **design)
    out = []
    for f, pole, gain in zip(centre, poles, gains, strict=True):
        den, num = np.poly(np.full(order, pole)), np.ones(1, complex)
        if exact and order > 1:
            m = order - 1
            euler = [sum((-1) ** j * math.comb(m + 1, j) * (k - j) ** m for j in range(k)) for k in range(1, m + 1)]
            num = np.concatenate([[0], np.array(euler) * pole ** np.arange(1, m + 1)])
            z = np.exp(-2j * np.pi * f / sample_rate)
            gain = 2 / abs(np.polyval(num[::-1], z) / np.polyval(den[::-1], z))
        out.append((gain * num, den))
    return centre, out


def gammatone(samples: DataFrame, sample_rate: float, exact: bool = False, **design) -> DataFrame:
    """(seq, n, x): real parts of all channels, then imaginary parts."""
    _, channels = gammatone_filters(sample_rate, exact, **design)
    return recursive(samples, **constant(channels), vectors=True)


def crests(poles: np.ndarray, order: int, exact: bool, latest: int) -> tuple[np.ndarray, np.ndarray]:
    """From the form of the responses, envelope(n) * pole**n: the sample at which each envelope is highest, latest at most, and the phase of the carrier there, a quarter turn behind that of its slope."""
    radius, m = np.abs(poles), order - 1
    if exact:
        envelope = lambda n: np.maximum(n, 0.0) ** m
        top = np.floor(1 / np.expm1(-np.log(radius) / m)) + 1 if m else np.zeros(len(poles))
    else:
        envelope = lambda n: np.prod([np.maximum(n + j, 0.0) / j for j in range(1, order)], axis=0) * (n >= 0)
        top = np.floor(m * radius / (1 - radius))
    at = np.minimum(top, latest)
    slope = envelope(at + 1) * poles - envelope(at - 1) / poles
    return at.astype(int), np.angle(poles) * at + np.angle(slope) - np.pi / 2


def level_weights(mixed: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Positive weights with which the channels' sum has gain 1 at every centre, by Newton's method on the gains. mixed: replies (centres, channels)."""
    weights = 1 / np.abs(mixed).sum(axis=1)
    for _ in range(rounds):
        total = mixed @ weights
        gain = np.abs(total)
        step = np.linalg.lstsq((total.conj()[:, None] * mixed).real / gain[:, None], 1 - gain, rcond=None)[0]
        falls = step < 0
        share = min(1.0, 0.9 * float(np.min(weights[falls] / -step[falls], initial=np.inf)))  # weights stay positive
        weights = weights + share * step
        if np.abs(step).max() < 1e-12:
            break
    return weights


def igammatone_design(sample_rate: float, desired_delay: float = 4, compensate_delay: bool = True, exact: bool = False, **design) -> tuple[np.ndarray, np.ndarray]:
    """Of each channel: how many samples it is moved by, and the complex factor of which the real part of its product counts."""
    centre, channels = gammatone_filters(sample_rate, exact, **design)
    _, poles, _ = gammatone_design(sample_rate, **design)
    shift = int(round(desired_delay * sample_rate / 1000))
    at, phase = crests(poles, design.get("filter_order", 4), exact, shift)

    def reply(frequency: np.ndarray) -> np.ndarray:
        """Of complex channels, each with its crest at shift, at some frequencies."""
        z = np.exp(-2j * np.pi * frequency / sample_rate)[:, None]
        return np.hstack([np.polyval(num[::-1], z) / np.polyval(den[::-1], z) for num, den in channels]) * np.exp(-1j * phase) * z ** (shift - at)

    # the real part of a channel is its mean with its conjugate, which replies at the mirrored frequency
    weights = level_weights((reply(centre) + reply(-centre).conj()) / 2)
    return shift - at - (shift if compensate_delay else 0), weights * np.exp(-1j * phase)


def igammatone(bands: DataFrame, sample_rate: float, desired_delay: float = 4, compensate_delay: bool = True, exact: bool = False, **design) -> DataFrame:
    """(seq, n, x) from gammatone(): channels are brought into phase at desired_delay (ms), weighted for a flat response, and added.

    A channel's part is moved by a few samples: each block adds its channels where they arrive.
    """
    move, factor = igammatone_design(sample_rate, desired_delay, compensate_delay, exact, **design)  # sample n of a channel arrives at n + move
    half = len(move)
    behind, before = max(0, int(move.max())), max(0, -int(move.min()))
    size = max(blocks.SIZE, behind + before)
    sizes = blocks.lengths(bands)
    n = F.col("n")
    low, high = F.greatest(F.floor((n - before) / F.lit(size)), F.lit(0)), F.least(F.floor((n + behind) / F.lit(size)), F.floor((F.col("length") - 1) / F.lit(size)))
    sent = blocks.joined(bands, sizes, ["seq"]).select("seq", F.explode(F.sequence(low, high)).alias("block"), n.cast("long").alias("n"), "length", F.col("x").cast("array<double>").alias("v"))

    def run(block: blocks.Block):
        begin, count = block.begin, block.count
        at = block.numbers - (begin - behind)
        y = np.zeros((behind + count + before, half))
        inside = (at >= 0) & (at < len(y))
        v = block.vectors[inside]
        y[at[inside]] = v[:, :half] * factor.real - v[:, half:] * factor.imag
        out = np.zeros(count)
        for k, m in enumerate(move):
            out += y[behind - m : behind - m + count, k]
        return np.arange(begin, begin + count), out

    return blocks.work(sent, run, size)


def smoothed_gain(wanted: np.ndarray, gain: float, fall: float, rise: float) -> np.ndarray:
    """A gain that follows what is wanted, by a share of the distance at each sample: one to fall, one to rise."""
    out = np.empty(len(wanted))
    for n, g in enumerate(wanted.tolist()):
        gain += (fall if g < gain else rise) * (g - gain)
        out[n] = gain
    return out


def gain_function(wanted: np.ndarray, fall: float, rise: float) -> tuple[np.ndarray, np.ndarray]:
    """The last gain as a function of the first one, 0 to 1: a rising chain of lines, by its corners.

    All first gains are led at once. While what is wanted lies outside of them, all go the same way and keep their shares of
    the distance; where it lies among them, the chain gets a corner there. Corners that have met are one.
    """
    first, last = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    scale, shift = 1.0, 0.0  # gains are scale * last + shift
    low, high = 0.0, 1.0
    for g in wanted.tolist():
        if g <= low or g >= high:
            share = fall if g <= low else rise
            scale, shift = scale * (1 - share), shift * (1 - share) + share * g
            low, high = low + share * (g - low), high + share * (g - high)
            continue
        last = scale * last + shift
        at = int(np.searchsorted(last, g))
        if last[at] != g:
            part = (g - last[at - 1]) / (last[at] - last[at - 1])
            first, last = np.insert(first, at, first[at - 1] + part * (first[at] - first[at - 1])), np.insert(last, at, g)
        last = last + np.where(last > g, fall, rise) * (g - last)
        apart = np.append(np.diff(last) > 1e-15, True)
        apart[0] = True
        first, last = first[apart], last[apart]
        scale, shift, low, high = 1.0, 0.0, float(last[0]), float(last[-1])
    return first, scale * last + shift


def drc(
    samples: DataFrame, sample_rate: float, threshold: float = -20, ratio: float = 2, attack_time: float = 1, release_time: float = 500, makeup_gain: float = 0, abs_max: float = 1, block: int = blocks.SIZE,
) -> DataFrame:
    """Dynamic range compression: a static gain above the threshold (dB), smoothed with one time to fall (attack) and one to rise (release), in ms.

    Every block makes its last gain a function of its first one, on its own; along a sequence one such function for each block
    is followed, and a second pass runs every block from its own first gain. Null samples take part in nothing and have no output.
    """
    smooth = lambda ms: 1 - math.exp(-1000 / (ms * sample_rate))
    fall, rise = smooth(attack_time), smooth(release_time)
    slope = 1 - 1 / ratio
    sent = blocks.sent(samples.filter("x IS NOT NULL AND NOT isnan(x)"), 0, 0, block)
    kind = sent.schema["seq"].dataType.simpleString()

    def wanted(x: np.ndarray) -> np.ndarray:
        return 10 ** (np.minimum(0.0, (threshold - 20 * np.log10(np.abs(x) / abs_max + 1e-10)) * slope) / 20)

    def corners(own: blocks.Block):
        if not own.count:
            return None
        first, last = gain_function(wanted(own.x), fall, rise)
        return np.full(len(first), own.number), np.stack([first, last], axis=1)

    functions = blocks.work(sent, corners, block, vectors=True).groupBy("seq", F.col("n").alias("block")).agg(F.sort_array(F.collect_list("x")).alias("corners"))

    def follow(batches):
        here, gain, begun = None, 1.0, False
        for batch in batches:
            out = []
            for owner, chain in zip(batch.column("seq").to_pylist(), batch.column("corners").to_pylist(), strict=True):
                if not begun or owner != here:
                    here, gain, begun = owner, 1.0, True
                out.append([gain])
                gain = float(np.interp(gain, *zip(*chain, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("block"), pa.array(out, pa.list_(pa.float64()))], ["seq", "block", "v"])

    gains = functions.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(follow, f"seq {kind}, block long, v array<double>")

    def whole(own: blocks.Block):
        if not own.count:
            return None
        gain = own.vectors[0][0] if own.vectors is not None else 1.0
        return own.n, smoothed_gain(wanted(own.x), gain, fall, rise) * own.x * 10 ** (makeup_gain / 20)

    return blocks.work(sent.unionByName(gains.withColumn("n", F.lit(-1).cast("long")), allowMissingColumns=True), whole, block)


def consistent(spectra: np.ndarray, places: np.ndarray, weights: np.ndarray, share: np.ndarray, fft_length: int, edges: Callable) -> np.ndarray:
    """The nearest spectra that a signal has: overlap-add, what lies outside the signal by its rule, and the frames' spectra again."""
    return np.fft.rfft(overlapped(spectra, places, weights, share, fft_length, edges)[places] * weights, fft_length)


def overlapped(spectra: np.ndarray, places: np.ndarray, weights: np.ndarray, share: np.ndarray, fft_length: int, edges: Callable) -> np.ndarray:
    parts = np.fft.irfft(spectra, fft_length)[:, : places.shape[1]] * weights
    return edges(np.bincount(places.reshape(-1), weights=parts.reshape(-1), minlength=len(share)) * share)


def griffin(
    spectra: DataFrame, frame_length: int, frame_period: int, fft_length: int, out_length: int | None = None, n_iter: int = 100, alpha: float = 0.99, beta: float = 0.99, gamma: float = 1.1,
    window: str | int = "blackman", norm: str | int = "power", symmetric: bool = True, seed: int | None = None, center: bool = True, mode: str = "constant",
) -> DataFrame:
    """(seq, n, x) whose power spectrogram comes near to (seq, t, x): phases by fast projections.

    A round carries a frame's phase over one frame's length and no further. So a block of frames with n_iter + 1 frame lengths
    of its neighbours to either side has the rounds to itself, with the result of the whole utterance: one shuffle, in which a
    frame goes to two or three blocks, and an utterance is spread over tasks. Phases start at zero, or at random ones of the
    seed. out_length cuts every sequence; without it a sequence is as long as its frames times the period. mode is constant,
    reflect or replicate.
    """
    require(mode_is_constant_reflect_or_replicate=mode in ("constant", "reflect", "replicate"))
    weights = bases.window_values(frame_length, window, norm, symmetric)
    left = frame_length // 2 if center else 0
    reach = (n_iter + 2) * -(-frame_length // frame_period)  # in frames
    size = max(1024, reach)
    t = F.col("t")
    ends = spectra.groupBy("seq").agg((F.max("t") + 1).cast("long").alias("length"))
    low, high = F.greatest(F.floor((t - reach) / F.lit(size)), F.lit(0)), F.least(F.floor((t + reach) / F.lit(size)), F.floor((F.col("length") - 1) / F.lit(size)))
    sent = blocks.joined(spectra, ends, ["seq"]).select("seq", F.explode(F.sequence(low, high)).alias("block"), t.cast("long").alias("n"), "length", F.col("x").cast("array<double>").alias("v"))

    def run(block: blocks.Block):
        first = int(block.numbers[0])
        size_ = np.sqrt(np.maximum(block.vectors, 0) + 1e-16)
        places = (block.numbers - first)[:, None] * frame_period + np.arange(frame_length)
        total = int(places.max()) + 1
        share = 1 / (np.bincount(places.reshape(-1), weights=np.tile(weights**2, len(places)), minlength=total) + 1e-16)
        length = block.length * frame_period if out_length is None else out_length
        begin, end = left - first * frame_period, left + length - first * frame_period  # the signal's own places here

        def edges(y: np.ndarray) -> np.ndarray:
            if begin > 0:
                y[:begin] = {"constant": 0.0, "replicate": y[begin : begin + 1], "reflect": y[begin + 1 : 2 * begin + 1][::-1] if len(y) > 2 * begin else 0.0}[mode]
            if end < total:
                own = y[max(begin, 0) : end]
                past = np.arange(total - end)
                y[end:] = 0.0 if mode == "constant" or not len(own) else own[-1] if mode == "replicate" else own[np.maximum(len(own) - 2 - past, 0)]
            return y

        unit = np.ones(size_.shape, complex)
        if seed is not None:
            turns = [np.random.default_rng([seed, int(k)]).random(size_.shape[1]) for k in block.numbers]
            unit = np.exp(2j * np.pi * np.array(turns))
        nearest = lambda unit: consistent(size_ * unit, places, weights, share, fft_length, edges)
        past = ahead = nearest(unit)
        lead = ahead
        for k in range(n_iter):
            if k:  # the projection, over-relaxed around the last point, then two steps ahead: one to project from, one to relax around
                moved = lead + gamma * (nearest(unit) - lead)
                speed = moved - past
                past, ahead, lead = moved, moved + alpha * speed, moved + beta * speed
            unit = ahead / (np.abs(ahead) + 1e-16)
        y = overlapped(size_ * unit, places, weights, share, fft_length, edges)
        a = max(block.begin * frame_period, 0)
        b = min(min(block.begin + size, block.length) * frame_period if out_length is None or block.begin + size < block.length else length, length)
        return np.arange(a, b), y[left + a - first * frame_period : left + b - first * frame_period]

    return blocks.work(sent, run, size)
