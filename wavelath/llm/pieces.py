"""SentencePiece encoding with source offsets, and decoding.

Normalisation takes the longest prefix that the model's compiled character map
knows, replaces it, and records for every byte of the result where in the
source it came from. The normalised text is cut into runs that no piece of the
vocabulary can cross; equal runs are encoded once per worker. Every piece is
then projected through the recorded alignment to a span of source bytes.

The library's own encoder merges pieces, with a copy of the model whose
normaliser does nothing, so that normalisation happens here and nowhere else.

Nulls count as empty texts; an empty text has no ids.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces as small
from .common import table

SPACE = "▁"
#: Bytes of the runs whose ids a worker keeps, each counted with RUN bytes of its own.
KNOWN = 96_000_000
RUN = 160


class CharacterMap:
    """The compiled character map of a model: a double-array trie of source prefixes and a block of replacements.

    Layout: the trie's size in bytes (uint32), its units (uint32 each), then replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.block = blob[4 + size :]
        #: Whether a prefix begins with each byte.
        self.first = np.array([self._begins(x) for x in range(256)])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest prefix of data[at:] in the trie: its length and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:  # a value hangs below
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        length, value = found
        return length, self.block[value : self.block.index(b"\0", value)]

    def _begins(self, first: int) -> bool:
        if not self.units:
            return False
        node = self._offset(self.units[0]) ^ first
        return node < len(self.units) and self.units[node] & 0x800000FF == first

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """The model's normaliser with alignment, for any character map: an empty one replaces nothing.

    Places at which a prefix can begin are found for the whole text at once, by its first byte; only there the trie is
    walked. What lies between is kept byte for byte. Blanks are then squeezed and written as the model writes them.
    """

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes and its end the source byte that it begins at."""
        normal, starts = self.placed(text)
        return normal, starts.tolist()

    def placed(self, text: str) -> tuple[str, np.ndarray]:
        """aligned() with places as an array. Bytes of one replacement, or of one character of the source, begin together."""
        data, space = text.encode(), (SPACE if self.escape else " ").encode()
        raw, at = self._replaced(data)
        end = len(data)
        if self.squeeze and len(raw):
            blank = raw == 32
            kept = ~blank
            kept[1:] |= ~blank[:-1]  # the first blank of a run
            kept[0] = not blank[0]
            if blank[-1]:  # trailing blanks go, and the text ends where they begin
                last = int(np.flatnonzero(~blank)[-1]) + 1 if not blank.all() else 0
                end = int(at[last]) if last else 0
                kept[last:] = False
            raw, at = raw[kept], at[kept]
        if not len(raw):
            return "", np.zeros(1, np.int32)
        first = [at[0]] if self.prefix else []
        if self.escape:
            at = np.repeat(at, 1 + (len(space) - 1) * (raw == 32))
            new = raw.tobytes().replace(b" ", space)
        else:
            new = raw.tobytes()
        return ((space if self.prefix else b"") + new).decode(), np.concatenate([np.repeat(np.array(first, np.int32), len(space)), at, np.array([end], np.int32)])

    def _replaced(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after the longest prefixes are replaced, and the source byte at which each one's character or prefix begins."""
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw), dtype=np.int32)
        head = True
        if not data.isascii():
            head = (raw & 0xC0) != 0x80
            at = np.maximum.accumulate(np.where(head, at, 0))
        out, places, done = [], [], 0
        first = getattr(self.map, "first", None)  # a map that does not know them is asked at every character
        asked = np.ones(len(raw), bool) & head if first is None else first[raw] & head if first.any() else ()
        for k in np.flatnonzero(asked).tolist():
            if k < done or not (found := self.map.longest(data, k)):
                continue
            length, new = found
            out += [raw[done:k], np.frombuffer(new, np.uint8)]
            places += [at[done:k], np.full(len(new), k)]
            done = k + length
        if not done:
            return raw, at
        return np.concatenate([*out, raw[done:]]), np.concatenate([*places, at[done:]])


class Encoder:
    """Encodes normalised text by runs."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.normalizer = Normalizer(model.normalizer_spec)
        plain = model_pb2.ModelProto()
        plain.CopyFrom(model)
        spec = plain.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        normal = [x.piece for x in model.pieces if x.type == 1]
        # no merge crosses a run when only pieces of blanks have a blank after their first character, and none holds a line break
        self.cut = model.trainer_spec.model_type == 2 and not any(SPACE in x[1:] and x.strip(SPACE) or "\n" in x and len(x) > 1 for x in normal) and all(x.type != 4 for x in model.pieces) and model.trainer_spec.byte_fallback
        self.runs = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._forget()
        self.sizes = np.array([1 if x.type == 6 else len(x.piece.encode()) for x in model.pieces])
        self.unknown = np.array([x.type == 2 for x in model.pieces])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts, one text after another, and where each text's begin and the last ends."""
        if not self.cut:
            found = self.inner.encode(texts, num_threads=1)
            return np.fromiter(chain.from_iterable(found), np.int32), np.cumsum([0, *map(len, found)])
        if self.held > KNOWN:  # bounds the memory; what is dropped is encoded again when it is met
            self._forget()
        split = [self.runs.findall(x) for x in texts]
        if new := list(set(chain.from_iterable(split)).difference(self.known)):
            found = self.inner.encode(new, num_threads=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes = np.fromiter(map(len, found), np.int64)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.count = np.concatenate([self.count, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
            self.held += len(new) * RUN + 4 * sum(map(len, new)) + 4 * int(sizes.sum())
        runs = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = self.count[runs]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(edges[-1]) + np.repeat(self.at[runs] - edges[:-1], sizes)
        return self.flat[place], edges[np.cumsum([0, *map(len, split)])]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spans(self, text: str, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source bytes of each id, from the alignment of the normalised text that the ids tile: begins and ends."""
        sizes = self.sizes[ids]
        if self.unknown[ids].any():  # such an id covers what no piece has, of any length
            sizes = np.array([len(x.surface.encode()) for x in self.inner.encode(text, return_type="proto").pieces])
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=edges[1:])
        edges = starts[edges]
        return edges[:-1], edges[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(tool: Encoder, texts: list[str], spans: bool) -> list[pa.Array]:
    """Arrow columns of some texts: ids, the decoded texts, and the begins and ends of the ids' source bytes."""
    normal = [tool.normalizer.placed(x) for x in texts]
    ids, at = tool.ids([x for x, _ in normal])
    lists = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    decoded = tool.decoder.decode([x.tolist() for x in lists]) if lists else []
    at = pa.array(at, pa.int32())
    out = [pa.ListArray.from_arrays(at, pa.array(ids)), pa.array(decoded, pa.string())]
    if spans:
        placed = [tool.spans(x, starts, i) for (x, starts), i in zip(normal, lists, strict=True)]
        for k in (0, 1):
            values = np.concatenate([np.zeros(0, np.int64), *(p[k] for p in placed)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(at, pa.array(values)))
    return out


def with_pieces(docs: DataFrame, model_path: str, column: str = "text", spans: bool = True) -> DataFrame:
    """The rows of docs, with ids, decoded, and the source bytes of each id as begins and ends; these replace columns of their names."""
    added = ["ids", "decoded"] + ["begins", "ends"] * spans
    kept = docs.drop(*added)

    def run(batches):
        tool = encoder(model_path)
        for batch in small(batches):
            new = encoded(tool, [x or "" for x in batch.column(column).to_pylist()], spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    numbers = T.ArrayType(T.IntegerType())
    kinds = [numbers, T.StringType()] + [numbers, numbers] * spans
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))]))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens and the digests of the ids, of the decoded text, and of all spans (begins, then ends); span_bytes is where the last span ends."""
    ids = F.array_join("ids", ",")
    out = [F.col(key), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    if "ends" in encoded.columns:
        out.append(F.sha2(F.concat(F.array_join("begins", ","), F.lit(";"), F.array_join("ends", ",")), 256).alias("spans_sha256"))
        out.append(F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("span_bytes"))
    return encoded.select(*out)


def op6_piece_spans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))
