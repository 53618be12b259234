"""WAV files as a data source: spark.read.format("wav"), df.write.format("wav").

Reading: a file is split by byte ranges, so that many tasks read one long file. Only headers are read where the plan is
made. Options: path (a file, a folder, or a pattern in the last part of the name; any address that pyarrow's file systems
open), start and frames (a stretch of every file, -1 frames for all), split (frames of a task's part).
Rows are (seq string, channel int, n long, x double, rate int): x lies between -1 and 1, seq is the path.

Writing: rows (seq, n, x) sorted by write() are written as numbered parts of bounded length, each a WAV file of its own,
under path/<seq>/part-<number>.wav: a sequence of any length, by many tasks. Tasks write under names of their own; a
commit gives the files theirs, an abort removes them. Places that are missing inside a part are silent, null samples too.
Reading a folder of such parts gives one sequence: a part's number tells where it begins.
"""

from __future__ import annotations

import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "seq string, channel int, n long, x double, rate int"
PART = re.compile(r"(.*)/part-(\d+)x(\d+)\.wav$")
#: Frames that leave a task at once.
BATCH = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """Where a file's samples are, and their form."""

    rate: int
    channels: int
    width: int
    is_float: bool
    begin: int
    frames: int


def header_of(file) -> Header:
    """From the chunks of a RIFF file; samples themselves are not read."""
    riff, _, kind = struct.unpack("<4sI4s", file.read(12))
    if riff != b"RIFF" or kind != b"WAVE":
        raise ValueError("not a WAV file")
    form, at, total = None, 12, file.size()
    while at + 8 <= total:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = file.read(size)
        elif name == b"data":
            if form is None:
                raise ValueError("a WAV file's form comes before its data")
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            code = struct.unpack("<H", form[24:26])[0] if code == 0xFFFE and len(form) >= 26 else code
            if code not in (1, 3):
                raise ValueError(f"WAV form {code} is not linear samples")
            return Header(rate, channels, bits // 8, code == 3, at + 8, min(size, total - at - 8) // (channels * bits // 8))
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def samples_of(raw: bytes, header: Header) -> np.ndarray:
    """(frames, channels) between -1 and 1."""
    if header.is_float:
        x = np.frombuffer(raw, f"<f{header.width}").astype(float)
    elif header.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif header.width == 3:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{header.width}") / 2.0 ** (8 * header.width - 1)
    return x.reshape(-1, header.channels)


@dataclass
class Stretch(InputPartition):
    """Frames of one file for one task; n is the place of the first one in its sequence."""

    path: str
    seq: str
    header: Header
    first: int
    count: int
    n: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.frames, self.split = (int(options.get(k, v)) for k, v in (("start", 0), ("frames", -1), ("split", 1 << 22)))
        if self.start < 0 or self.split < 1:
            raise ValueError("start is not negative, and split is one frame at least")

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        base = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        if "*" in root.rsplit("/", 1)[-1]:
            folder, pattern = root.rsplit("/", 1)
            wanted = re.compile(".*".join(map(re.escape, pattern.split("*"))) + "$")
            found = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if wanted.match(x.base_name)]
        elif system.get_file_info(root).type == fs.FileType.Directory:
            found = [x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".wav") and not x.base_name.startswith(("_", "."))]
        else:
            found = [root]
        out: list[InputPartition] = []
        for path in sorted(found):
            with system.open_input_file(path) as f:
                header = header_of(f)
            part = PART.match(path)
            seq, origin = (urllib.parse.unquote(part[1].rsplit("/", 1)[-1]), int(part[2]) * int(part[3])) if part else (base + path, 0)
            last = header.frames if self.frames < 0 else min(header.frames, self.start + self.frames - origin)
            for first in range(max(0, self.start - origin), last, self.split):
                out.append(Stretch(base + path, seq, header, first, min(self.split, last - first), origin + first))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, path = opened(partition.path)
        header, size = partition.header, partition.header.width * partition.header.channels
        with system.open_input_file(path) as f:
            for at in range(0, partition.count, BATCH):
                count = min(BATCH, partition.count - at)
                f.seek(header.begin + (partition.first + at) * size)
                x = samples_of(f.read(count * size), header)
                n = np.arange(partition.n + at, partition.n + at + len(x))
                for c in range(header.channels):
                    columns = [pa.array([partition.seq] * len(x), pa.string()), pa.array(np.full(len(x), c, np.int32)), pa.array(n), pa.array(np.ascontiguousarray(x[:, c])), pa.array(np.full(len(x), header.rate, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["seq", "channel", "n", "x", "rate"])


def header_bytes(frames: int, rate: int) -> bytes:
    """Of 16-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * frames, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * frames)


@dataclass
class Written(WriterCommitMessage):
    """A task's files: the name that each has, and the one that it shall have."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WavWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.rate, self.part = options["path"], int(options["rate"]), int(options.get("part", 1 << 20))
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        done = Written()
        own = f"{root}/_{self.run}/{uuid.uuid4().hex}"  # a task that is tried again does not meet its first files
        here, held, end = None, [], 0

        def close():
            if here is None:
                return
            seq, number = here
            n, x = (np.concatenate(c) for c in zip(*held, strict=True))
            # inside its last part a sequence ends with its last sample, before that parts are full
            pcm = np.zeros(end, "<i2")
            pcm[n - number * self.part] = np.clip(np.round(np.nan_to_num(x) * 32768), -32768, 32767).astype("<i2")
            name = f"{urllib.parse.quote(str(seq), safe='')}/part-{number:06d}x{self.part}.wav"
            system.create_dir(f"{own}/{name.rsplit('/', 1)[0]}", recursive=True)
            with system.open_output_stream(f"{own}/{name}") as f:
                f.write(header_bytes(len(pcm), self.rate))
                f.write(pcm.tobytes())
            done.files.append((f"{own}/{name}", f"{root}/{name}"))

        for batch in batches:
            seqs, n = batch.column("seq").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
            last = batch.column("last").to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = n // self.part
            cuts = [0, *[k for k in range(1, len(n)) if numbers[k] != numbers[k - 1] or seqs[k] != seqs[k - 1]], len(n)] if len(n) else [0]
            for a, b in zip(cuts, cuts[1:]):
                at = (seqs[a], int(numbers[a]))
                if at != here:
                    close()
                    here, held, end = at, [], int(min(self.part, last[a] + 1 - at[1] * self.part))
                held.append((n[a:b], x[a:b]))
        close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for made, name in (f for m in messages if m is not None for f in m.files):
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            system.move(made, name)
        self.clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*opened(self.path))

    def clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_{self.run}")


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options))


def write(samples: DataFrame, path: str, rate: int, part: int = 1 << 20) -> None:
    """Samples (seq, n, x) between -1 and 1 as 16-bit parts of so many frames: each part is one task's work, whatever its sequence's length."""
    samples.sparkSession.dataSource.register(Wav)
    last = samples.groupBy("seq").agg(F.max("n").cast("long").alias("last"))
    rows = samples.select("seq", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x")).join(last, "seq").withColumn("block", F.floor(F.col("n") / part))
    rows.repartition("seq", "block").sortWithinPartitions("seq", "block", "n").select("seq", "n", "x", "last").write.format("wav").option("path", path).option("rate", rate).option("part", part).mode("append").save()
