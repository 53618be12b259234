"""Media columns with content-defined payload chunking.

Every payload is stored as an 8-bit mono WAV stream. A rolling gear hash cuts
the samples into chunks, so equal passages give equal chunks wherever they
stand. Chunk digests are counted in a Spark aggregation; the bytes of a chunk
that stands in several places are stored once, in the chunk table, and every
document keeps an ordered chunk list. Reading joins the lists with the chunk
table, puts the stream together and verifies its digest.

A chunk that stands in one place only stays in its document's row, so that its
bytes are never shuffled. Which chunks go to the chunk table is decided by a
bitmap of fixed size over the digests that occur more than once. Chance hits in
the bitmap only send a chunk to the table that could have stayed.

Nulls, empty texts: the payload is 192 blanks. Equal texts share all chunks.
Rows are told apart by a row number, so repeated rows and null doc_ids stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, stage_table, table

UNIT = 192
#: Rows whose payloads and streams a task holds at once.
ROWS = 64
SAMPLE_RATE = 8000
HEADER = 44
#: A gear value per byte, by rule.
GEAR = (mix64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Chunker:
    """Cuts where the top bits of the gear hash of the last 32 bytes are zero: 2**mask_bits bytes between cuts on average."""

    mask_bits: int = 11
    min_size: int = 512
    max_size: int = 16384
    #: Bits in the map of repeated digests.
    map_bits: int = 1 << 24

    def cuts(self, data: bytes) -> list[int]:
        """The end of each chunk."""
        hashes = GEAR[np.frombuffer(data, np.uint8)]
        width = 1
        while width < 32:  # doubling the window: h(2w)[i] = h(w)[i] + (h(w)[i-w] << w)
            wider = hashes.copy()
            wider[width:] += hashes[:-width] << np.uint32(width)
            hashes, width = wider, 2 * width
        found, at, ends = np.flatnonzero(hashes >> np.uint32(32 - self.mask_bits) == 0) + 1, 0, []
        for end in found.tolist():
            while end - at > self.max_size:
                at += self.max_size
                ends.append(at)
            if end - at >= self.min_size:
                ends.append(end)
                at = end
        while len(data) - at > self.max_size:
            at += self.max_size
            ends.append(at)
        if at < len(data):
            ends.append(len(data))
        return ends

    def chunks(self, data: bytes) -> list[bytes]:
        at, out = 0, []
        for end in self.cuts(data):
            out.append(data[at:end])
            at = end
        return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def bit_of(name: bytes, bits: int) -> int:
    return int.from_bytes(name[:7], "big") % bits


def wav_header(samples: int) -> bytes:
    """RIFF/WAVE header of 8-bit mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + samples, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", samples)


def wav_samples(media: bytes) -> bytes:
    """The samples of a stream that wav_header began."""
    riff, size, kind, _, _, _, channels, _, _, _, bits, data, samples = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, kind, data, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 8) or len(media) != HEADER + samples or size != len(media) - 8:
        raise ValueError("not an 8-bit mono WAV stream")
    return media[HEADER:]


def feature(samples: bytes) -> str:
    """Whole-number statistics of the signal: mean, energy and crossings of the mean, all times 1000, and the loudest of 16 segments."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    above = x * n >= total
    centred = x * n - total
    parts = np.add.reduceat(np.abs(centred), np.arange(16) * (n // 16))
    return f"mean={total * 1000 // n};energy={int((x * x).sum()) * 1000 // n};crossings={int((above[1:] != above[:-1]).sum()) * 1000 // n};loudest={int(parts.argmax())}"


def with_payload(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes and the padded payload of each row."""
    data = F.coalesce(F.col(column), F.lit(""))
    size = F.octet_length(data)
    padded = F.greatest(F.ceil(size / F.lit(UNIT)), F.lit(1)) * UNIT
    return docs.select("doc_id", size.cast("long").alias("n_bytes"), F.concat(data, F.repeat(F.lit(" "), (padded - size).cast("int"))).cast("binary").alias("payload"))


def repeated_bits(docs: DataFrame, chunker: Chunker) -> np.ndarray:
    """The bitmap of chunk digests that occur more than once: map_bits / 8 bytes at any input size."""

    def names(batches):
        for batch in pieces(batches, ROWS):
            out = [digest(c) for data in batch.column("payload").to_pylist() for c in chunker.chunks(data)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([bit_of(x, chunker.map_bits) for x in out], pa.int64())], ["name", "bit"])

    counted = docs.select("payload").mapInArrow(names, "name binary, bit long").groupBy("name", "bit").count().filter("count > 1")
    words = counted.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("mask"))
    got = words.toPandas()  # one row for each 64 bits of the map at most
    bitmap = np.zeros(chunker.map_bits // 64, np.int64)
    bitmap[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def store(docs: DataFrame, chunker: Chunker = Chunker()) -> tuple[DataFrame, DataFrame]:
    """Writes rows of doc_id, n_bytes and payload as media. Returns the documents' chunk lists and the chunk table.

    Lists: uid, doc_id, n_bytes, media_sha256, names (binary, null for a chunk kept in the row), sizes, kept (the bytes of those).
    Chunks: name, data.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs, chunker))

    def shared(name: bytes) -> bool:
        bit = bit_of(name, chunker.map_bits)
        return bool(int(bitmap.value[bit >> 6]) >> (bit & 63) & 1)

    def lists(batches):
        for batch in pieces(batches, ROWS):
            names, sizes, kept, shas = [], [], [], []
            for data in batch.column("payload").to_pylist():
                found = chunker.chunks(data)
                marked = [x if shared(x) else None for x in map(digest, found)]
                names.append(marked)
                sizes.append([len(c) for c in found])
                kept.append(b"".join(c for c, x in zip(found, marked, strict=True) if x is None))
                shas.append(hashlib.sha256(wav_header(len(data)) + data).hexdigest())
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(shas), pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media_sha256", "names", "sizes", "kept"])

    def contents(batches):
        for batch in pieces(batches, ROWS):
            seen = {}  # of this batch: fewer repeats to shuffle
            for data in batch.column("payload").to_pylist():
                seen.update((x, c) for c in chunker.chunks(data) if shared(x := digest(c)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["name", "data"])

    schema = "doc_id long, n_bytes long, media_sha256 string, names array<binary>, sizes array<int>, kept binary"
    manifest = docs.mapInArrow(lists, schema).withColumn("uid", F.monotonically_increasing_id())
    chunks = docs.select("payload").mapInArrow(contents, "name binary, data binary").dropDuplicates(["name"])
    return stage_table(manifest, "lists"), stage_table(chunks, "chunks")


def restore(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Puts every stream together by its chunk list: doc_id, n_bytes and the verified media."""
    own = manifest.filter(~F.exists("names", lambda x: x.isNotNull()))
    part = manifest.filter(F.exists("names", lambda x: x.isNotNull()))
    wanted = part.select("uid", F.posexplode("names").alias("at", "name")).filter("name is not null")
    fetched = wanted.join(chunks, "name").select("uid", F.struct("at", "data").alias("piece"))
    whole = part.withColumn("piece", F.lit(None).cast("struct<at:int,data:binary>"))
    columns = ["doc_id", "n_bytes", "media_sha256", "sizes", "kept"]
    # one row of the group is the list itself, the others are the pieces fetched for it
    met = (
        whole.select("uid", F.struct(*columns, "names").alias("row"), "piece")
        .unionByName(fetched.withColumn("row", F.lit(None).cast(whole.select(F.struct(*columns, "names").alias("row")).schema["row"].dataType)))
        .groupBy("uid")
        .agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list("piece").alias("pieces"))
        .select("row.*", "pieces")
    )
    own = own.select(*columns, "names").withColumn("pieces", F.array().cast("array<struct<at:int,data:binary>>"))

    def join(batches):
        for batch in pieces(batches, ROWS):
            got = batch.to_pydict()
            media = []
            for sizes, names, kept, fetched, sha in zip(got["sizes"], got["names"], got["kept"], got["pieces"], got["media_sha256"], strict=True):
                by_place = {x["at"]: x["data"] for x in fetched}
                at, out = 0, [wav_header(sum(sizes))]
                for k, (size, name) in enumerate(zip(sizes, names, strict=True)):
                    if name is None:
                        out.append(kept[at : at + size])
                        at += size
                    else:
                        out.append(by_place[k])
                stream = b"".join(out)
                if hashlib.sha256(stream).hexdigest() != sha:
                    raise ValueError("a stream put together from its chunks differs from the stored one")
                media.append(stream)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return own.unionByName(met.select(*own.columns)).mapInArrow(join, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the samples read back."""

    def read(batches):
        for batch in pieces(batches, ROWS):
            rows = []
            for stream in batch.column("media").to_pylist():
                samples = wav_samples(stream)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples)))
            sizes, shas, tails, lengths, stored, features = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(tails, pa.int64()), pa.array(lengths, pa.int64()), pa.array(stored, pa.string()), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(read, schema)


def op1_payload_chunks(spark, sf_dir: str) -> DataFrame:
    docs = with_payload(table(spark, sf_dir, "documents"))
    return describe(restore(*store(docs)))
