"""Helpers that several operators share: the shared folder, intermediate tables, tables by name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

#: Deletes the shuffle files of an intermediate write once its table stands in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="wavelath-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Folders of intermediate tables made since an outer step began, by nesting.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables made inside, once what needs them has been written."""
    _MADE.append([])
    try:
        yield
    finally:
        for folder in _MADE.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str, partition_by: str | None = None, lasting: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs no rework before it.

    A lasting table outlives the scratch() that it is made in.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/wavelath/{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    if _MADE and not lasting:
        _MADE[-1].append(folder)
    kept = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **more) -> DataFrame:
    """docs as one column, row, beside more: whatever its columns are called, nothing clashes. select("row.*") brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64: a fixed pseudo-random function of each element."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a piece that holds more than one row.
PIECE = 1 << 24


def pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """The same rows in smaller Arrow batches, bounded in rows and in bytes, so that what a task holds at once stays small: very long texts come one by one."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(batch.num_rows - 1 - (batch.num_rows - 1) % rows, -1, -rows)] if batch.num_rows else []
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > PIECE:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def bitmap(cells: DataFrame, bits: int, map_bits: int) -> tuple:
    """A broadcast bitmap of the column cell (numbers of so many bits), and how many bits it is over: their first map_bits, so that its size is fixed whatever cells holds."""
    own = min(bits, map_bits)
    bit = F.shiftrightunsigned("cell", bits - own) + 1
    rows = cells.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map")).toArrow()
    mask = np.zeros(max(1 << own >> 3, 4096), np.uint8)
    for bucket, part in zip(rows.column("bucket").to_pylist(), rows.column("map").to_pylist(), strict=True):
        mask[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return cells.sparkSession.sparkContext.broadcast(mask), own


def lets_through(mask: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether a bitmap of the first bits of keys of 64 bits has those of each key."""
    at = keys >> np.uint64(64 - bits)
    return mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
