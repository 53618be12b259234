"""Tables as sequences and vectors, signal generators, and WAV files."""

from __future__ import annotations

import io
import math
import struct
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import batched
from ..operators.blocks import joined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """(seq, n, x): rows of a key in order of time, then tie, counted from 0. Every row is counted: a null key is a sequence
    of its own, and rows without a time, or with a tie that is null, come last.

    Counting is by day: ranks inside a day, and running totals of days before it, so that a key with very many rows is
    counted by many tasks.
    """
    held = rows.select(F.col(key).alias("seq"), F.col(time).alias("_time"), F.col(tie).alias("_tie"), F.col(value).cast("double").alias("x"), F.to_date(time).alias("_day"))
    days = held.groupBy("seq", "_day").agg(F.count("*").alias("_rows"))
    before = days.select("seq", "_day", F.coalesce(F.sum("_rows").over(W.partitionBy("seq").orderBy(F.col("_day").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("seq", "_day").orderBy(F.col("_time").asc_nulls_last(), F.col("_tie").asc_nulls_last()))
    return joined(held.withColumn("_rank", rank), before, ["seq", "_day"]).select("seq", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("n"), "x")


def vectors(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(id, x): arrays as vectors of doubles."""
    return rows.select(F.col(key).alias("id"), F.col(value).cast("array<double>").alias("x"))


# --- generators: (n, x), order + 1 samples


def counted(spark: SparkSession, order: int) -> DataFrame:
    return spark.range(order + 1).withColumnRenamed("id", "n")


def impulse(spark: SparkSession, order: int) -> DataFrame:
    return counted(spark, order).withColumn("x", F.when(F.col("n") == 0, 1.0).otherwise(0.0))


def step(spark: SparkSession, order: int, value: float = 1) -> DataFrame:
    return counted(spark, order).withColumn("x", F.lit(float(value)))


def ramp(spark: SparkSession, arg: float, end: float | None = None, step: float = 1, eps: float = 1e-8) -> DataFrame:
    """From 0 to arg, or from arg to end, the end included."""
    if step == 0:
        raise ValueError("step is not zero")
    begin, end = (0.0, arg) if end is None else (arg, end)
    count = max(0, math.ceil((end - begin + math.copysign(eps, step)) / step))
    return spark.range(count).select(F.col("id").alias("n"), (F.lit(float(begin)) + F.col("id") * float(step)).alias("x"))


def sin(spark: SparkSession, order: int, period: float | None = None, magnitude: float = 1) -> DataFrame:
    return counted(spark, order).withColumn("x", F.sin(F.col("n") * (2 * math.pi / (period or order + 1))) * float(magnitude))


def train(spark: SparkSession, order: int, frame_period: float, norm: str | int = "power") -> DataFrame:
    """Pulses a period apart, the first at 0."""
    if frame_period < 1:
        raise ValueError("the period is one sample at least")
    height = {0: 1.0, "none": 1.0, 1: frame_period**0.5, "power": frame_period**0.5, 2: float(frame_period), "magnitude": float(frame_period)}[norm]
    turns = lambda n: F.floor((n - 1) / F.lit(float(frame_period)) + 1e-12)
    return counted(spark, order).withColumn("x", F.when(turns(F.col("n") + 1) > turns(F.col("n")), height).otherwise(0.0))


def _shift() -> list[int]:
    """One step of a 32-bit register with taps 0 and 28, as the images of its 32 bits."""
    def step(r: int) -> int:
        r >>= 1
        return r | ((r ^ r >> 28) & 1) << 31

    return [step(1 << k) for k in range(32)]


def _moved(matrix: list[int], register: int) -> int:
    out = 0
    for k in range(32):
        if register >> k & 1:
            out ^= matrix[k]
    return out


def mseq_signs(begin: int, count: int) -> np.ndarray:
    """count values from begin on: the register is moved ahead by squaring its step."""
    register, matrix, far = 0x55555555, _shift(), begin
    while far:
        if far & 1:
            register = _moved(matrix, register)
        matrix = [_moved(matrix, m) for m in matrix]
        far >>= 1
    out = np.empty(count)
    for k in range(count):
        register >>= 1
        register |= ((register ^ register >> 28) & 1) << 31
        out[k] = 1.0 if register & 1 else -1.0
    return out


def mseq_at(n):
    """The m-sequence at places n, a column of whole numbers from 0 on. Places of a batch that lie together are made together."""

    def signs(places: np.ndarray) -> np.ndarray:
        whole, out = places.astype(np.int64), np.empty(len(places))
        for block in np.unique(whole // 4096):
            own = whole // 4096 == block
            rest = whole[own] - block * 4096
            out[own] = mseq_signs(int(block) * 4096, int(rest.max()) + 1)[rest]
        return out

    return batched(signs, n.cast("double"), returns="double")


def mseq(spark: SparkSession, order: int) -> DataFrame:
    """A maximal sequence of 1 and -1 from a shift register of 32 bits with taps 0 and 28, made in tasks."""
    return counted(spark, order).withColumn("x", mseq_at(F.col("n")))


def mseq_like(samples: DataFrame) -> DataFrame:
    """samples with x from the sequence, by n."""
    return samples.withColumn("x", mseq_at(F.col("n")))


def uniform(seed: int, stream: int, n="n"):
    """A number strictly between 0 and 1 from a digest of seed, stream and place: the same one however the rows are dealt out."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), n).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def nrand(spark: SparkSession, order: int, mean: float = 0, stdv: float = 1, seed: int = 0) -> DataFrame:
    normal = F.sqrt(-2 * F.ln(uniform(seed, 1))) * F.cos(2 * math.pi * uniform(seed, 2))
    return counted(spark, order).withColumn("x", normal * float(stdv) + float(mean))


def rand(spark: SparkSession, order: int, a: float = 0, b: float = 1, seed: int = 0) -> DataFrame:
    return counted(spark, order).withColumn("x", uniform(seed, 0) * float(b - a) + float(a))


# --- WAV files


def decoded(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate, and samples (frames, channels) between -1 and 1."""
    with wave.open(io.BytesIO(content)) as f:
        rate, width, channels, raw = f.getframerate(), f.getsampwidth(), f.getnchannels(), f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(float)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return rate, x.reshape(-1, channels) / 2.0 ** (8 * width - 1)


def read(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    """(seq, channel, n, x, rate) of PCM WAV files; seq is the path. A file has to fit a task; its samples leave in chunks."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rate, x = decoded(content)
                for c in range(x.shape[1]):
                    for at in range(0, len(x), chunk):
                        part = x[at : at + chunk, c]
                        yield pd.DataFrame({"seq": name, "channel": c, "n": np.arange(at, at + len(part)), "x": part, "rate": rate})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "seq string, channel int, n long, x double, rate int")


def encoded(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV of samples between -1 and 1."""
    pcm = np.clip(np.round(x * 32768), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(pcm)) + pcm


def write(samples: DataFrame, path: str, sample_rate: int) -> None:
    """Each sequence as 16-bit WAV bytes in a Parquet table of (seq, content): files that any store can hold. A sequence has to fit a task."""
    import pandas as pd

    def run(pdf):
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "content": [encoded(pdf.sort_values("n")["x"].to_numpy(), sample_rate)]})

    kind = samples.schema["seq"].dataType.simpleString()
    samples.select("seq", "n", "x").groupBy("seq").applyInPandas(run, f"seq {kind}, content binary").write.parquet(path)
