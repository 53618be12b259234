"""Work on sequences in blocks of places, each with the neighbouring places that it needs.

A sample is sent to the block it stands in, and near an edge to the next one too:
one shuffle of little more than the samples, whatever the reach, since a block is
at least as long as its reach to both sides. Rows arrive sorted by block and pass
through a task as a stream, so that memory is bounded by one block and one batch.
A hot sequence is as many blocks as it is long, spread over all tasks.

Vectors that blocks need beside samples (frames of coefficients, states) travel in
the same shuffle. Null and NaN samples take part in nothing: their places count as
zeros, or as missing for a median. Rows repeated for one place are each counted. A
null seq is a sequence like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a block; longer where the reach is longer.
SIZE = 8192


def joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of other, joined by keys of which null is one too."""
    named = other.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return rows.join(named, same, how).drop(*[f"_other_{k}" for k in keys])


def lengths(samples: DataFrame) -> DataFrame:
    """seq and its length, one row for each sequence."""
    return samples.groupBy("seq").agg((F.max("n") + 1).cast("long").alias("length"))


class Block:
    """One block's rows: places n and values x of samples (in order of n), vectors by their own numbers, and the sequence's length."""

    def __init__(self, number: int, size: int, n: np.ndarray, x: np.ndarray, length: int, numbers: np.ndarray, vectors: np.ndarray | None):
        self.number, self.n, self.x, self.length, self.numbers, self.vectors = number, n, x, length, numbers, vectors
        self.begin = number * size
        self.count = max(0, min(size, length - self.begin))

    def values(self, left: int = 0, right: int = 0, hold_end: int = 0) -> np.ndarray:
        """The samples from left places before the block to right places behind it, zeros where there is none; hold_end repeats the last sample."""
        total = left + self.count + right
        at = self.n - (self.begin - left)
        own = (at >= 0) & (at < total) & ~np.isnan(self.x)
        out = np.bincount(at[own], weights=self.x[own], minlength=total) if own.any() else np.zeros(total)
        end = self.length - (self.begin - left)
        if hold_end and 0 < end < total:
            out[end : end + hold_end] = out[end - 1]
        return out

    def between_frames(self, left: int, right: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of each place from left before the block to right behind it, drawn along a line from frame to frame; and the places of the sequence that have a frame; elsewhere they are zeros."""
        places = np.arange(self.begin - left, self.begin + self.count + right)
        t, share = places // period, (places % period) / period
        known = np.isin(t, self.numbers) & (places >= 0) & (places < self.length)
        row = np.clip(np.searchsorted(self.numbers, t), 0, len(self.numbers) - 1)
        after = np.clip(np.searchsorted(self.numbers, t + 1), 0, len(self.numbers) - 1)
        after = np.where(self.numbers[after] == t + 1, after, row)
        here = self.vectors[row]
        return np.where(known[:, None], here + (self.vectors[after] - here) * share[:, None], 0.0), known


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, Block]]:
    """The blocks of sorted rows (seq, block, n, x, length, v), and the seq of each."""
    held: list[pa.RecordBatch] = []

    def made(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        get = lambda c: rows.column(c).to_numpy()
        n, lists = get("n"), rows.column("v").combine_chunks()
        if lists.null_count == len(lists):
            numbers, vectors, sample = np.zeros(0, np.int64), None, slice(None)
        else:
            framed = np.asarray(lists.is_valid())
            numbers, first = np.unique(n[framed], return_index=True)
            vectors = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(framed.sum()), -1)[first]
            sample = ~framed
        length = rows.column("length").drop_null()
        return rows.column("seq")[0].as_py(), Block(rows.column("block")[0].as_py(), size, n[sample], get("x")[sample].astype(float), length[0].as_py() if len(length) else 0, numbers, vectors)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, numbers = batch.column("seq"), batch.column("block").to_numpy()
        seqs = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (seqs[1:] != seqs[:-1])) + 1).tolist(), len(numbers)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = batch.slice(a, b - a)
            if held and (k or not _same(held[-1], part)):
                yield made(held)
                held = []
            held.append(part)
    if held:
        yield made(held)


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    last, first = a.slice(a.num_rows - 1, 1), b.slice(0, 1)
    return all(last.column(c)[0].as_py() == first.column(c)[0].as_py() for c in ("seq", "block"))


def sent(samples: DataFrame, left: int, right: int, size: int) -> DataFrame:
    """(seq, block, n, x, length): each sample for every block that reaches it."""
    n, last = F.col("n"), F.floor((F.col("length") - 1) / F.lit(size))
    low, high = F.greatest(F.floor((n - right) / F.lit(size)), F.lit(0)), F.least(F.floor((n + left) / F.lit(size)), last)
    return joined(samples, lengths(samples), ["seq"]).filter("n >= 0").select("seq", F.explode(F.sequence(low, high)).alias("block"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"), "length")


def sent_vectors(vectors: DataFrame, place: Column, before: int, behind: int, size: int) -> DataFrame:
    """(seq, block, n, v): vectors (seq, t, x) for every block that they stand in, or that begins up to before places after them or ends up to behind before them; n is t."""
    low, high = F.floor((place - behind) / F.lit(size)), F.floor((place + before) / F.lit(size))
    return vectors.select("seq", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))).alias("block"), F.col("t").cast("long").alias("n"), F.col("x").cast("array<double>").alias("v"))


def work(rows: DataFrame, run: Callable[[Block], tuple[np.ndarray, np.ndarray] | None], size: int, vectors: bool = False) -> DataFrame:
    """(seq, n, x) of run(block) -> (places, values); values are rows of numbers with vectors. rows: seq, block, n and x, length or v."""
    for name, kind in (("x", "double"), ("length", "bigint"), ("v", "array<double>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))

    def stream(batches):
        ids, places, values, count = [], [], [], 0

        def full():
            x = np.concatenate(values)
            flat = pa.array(np.ascontiguousarray(x, dtype=float).reshape(-1), from_pandas=True)
            out = flat if not vectors else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            owner = np.repeat(np.arange(len(ids)), [len(p) for p in places])
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_of_seq).take(pa.array(owner)), pa.array(np.concatenate(places).astype(np.int64)), out], ["seq", "n", "x"])

        kind_of_seq = None

        def noted(source):
            nonlocal kind_of_seq
            for batch in source:
                kind_of_seq = batch.schema.field("seq").type
                yield batch

        for seq, block in _blocks(noted(batches), size):
            got = run(block)
            if got is None or not len(got[0]):
                continue
            ids.append(seq)
            places.append(got[0])
            values.append(got[1])
            count += got[1].size
            if count >= 100_000:
                yield full()
                ids, places, values, count = [], [], [], 0
        if ids:
            yield full()

    kind = rows.schema["seq"].dataType.simpleString()
    ordered = rows.select("seq", "block", "n", "x", "length", "v").repartition("seq", "block").sortWithinPartitions("seq", "block", "n")
    return ordered.mapInArrow(stream, f"seq {kind}, n long, x {'array<double>' if vectors else 'double'}")


def each(samples: DataFrame, left: int, right: int, run: Callable[[Block], np.ndarray], vectors: bool = False, size: int | None = None, scale: int = 1) -> DataFrame:
    """(seq, n, x) of run(block), one value, or scale values, for each place of the block; it may look left and right places beyond it."""
    size = size or max(SIZE, left + right)

    def places(block: Block):
        return np.arange(block.begin * scale, (block.begin + block.count) * scale), run(block)

    return work(sent(samples, left, right, size), places, size, vectors)


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Rows of y[n] = sum of taps[k] * x[n + last - k] where all taps lie inside; (places, filters)."""
    width = taps.shape[1]
    if width <= 64:
        return np.stack([np.convolve(x, t, "valid") for t in taps], axis=1)
    fft = 1 << (len(x) + width - 2).bit_length()
    both = np.fft.irfft(np.fft.rfft(x, fft)[None, :] * np.fft.rfft(taps, fft, axis=1), fft, axis=1)
    return both[:, width - 1 : len(x)].T
