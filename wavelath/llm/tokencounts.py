"""Token counts of fields and sections, by the places of a whole document's tokens.

A document is encoded once and whole, so that its tokens are those a model would
see. Byte-level tokens tile the text's bytes: running sums of their lengths are
their spans. Sections are intervals of the same text, given in code points, or
cut from the text by a rule. Both lists are in order, so that the interval join
of a document's tokens with its sections is two searches for each section.

A token that crosses a boundary is allocated by an explicit rule:

- middle: to the section that holds its middle byte (of two, the earlier one),
  which of two sections is the one with the larger part;
- start: to the section that holds its first byte;
- share: to each section by the part of its bytes that stands there.

Sections may overlap or leave gaps; each is counted by itself, and tokens that
no section holds are in no count. A section is clipped to the text. Null texts
count as empty; null or no sections give no counts. Repeated rows stay.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

RULES = ("middle", "start", "share")


@dataclass(frozen=True)
class ByteTokens:
    """A byte-level vocabulary: a file of ranks and the pattern that cuts texts into words."""

    path: str
    pattern: str


@lru_cache(maxsize=2)
def encoding(tokens: ByteTokens):
    import tiktoken

    with open(tokens.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=tokens.pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_edges(text: str, tokens: ByteTokens) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text, and the byte at which each begins and the last ends."""
    tool, sizes = encoding(tokens)
    ids = tool.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(sizes[ids])])


def line_starts(data: bytes) -> np.ndarray:
    """Sections that tile a text: its lines, each with its line break. The byte at which each begins and the last ends."""
    if not data:
        return np.zeros(1, np.int64)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    inner = breaks[breaks < len(data)]
    return np.concatenate([[0], inner, [len(data)]])


def in_bytes(data: bytes, points: np.ndarray) -> np.ndarray:
    """Code points as bytes; what lies outside the text is moved to its ends."""
    leads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    places = np.concatenate([leads, [len(data)]])
    return places[np.clip(points, 0, len(leads))]


def held(edges: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each section: its tokens by the rule, and how many tokens stand partly inside it and partly outside."""
    first, last = edges[:-1], edges[1:]
    empty = ends <= begins
    cross = lambda at: (np.searchsorted(first, at, "left") > np.searchsorted(last, at, "right")).astype(np.int64)
    at_begin, at_end = cross(begins), cross(ends)
    same = (at_begin & at_end).astype(bool) & (np.searchsorted(last, begins, "right") == np.searchsorted(last, ends, "right"))
    crossing = np.where(empty, 0, at_begin + at_end - same)
    if rule == "share":
        done = lambda at: np.interp(at, edges, np.arange(len(edges)))
        return np.where(empty, 0.0, done(ends) - done(begins)), crossing
    place = first if rule == "start" else first + (last - first - 1) // 2
    return np.where(empty, 0, np.searchsorted(place, ends, "left") - np.searchsorted(place, begins, "left")).astype(float), crossing


def attribute(
    docs: DataFrame, tokens: ByteTokens, sections: str | Callable[[bytes], np.ndarray], rule: str = "middle", column: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Per row: key, n_tokens, and lists along the sections: names (null for cut ones), tokens, crossing.

    sections: a column of array<struct<name string, start int, end int>> in code points, or a rule that cuts the
    bytes of a text into sections that tile it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    cut = sections if callable(sections) else None

    def run(batches):
        for batch in pieces(batches, 128):
            totals, names, counts, crossings = [], [], [], []
            given = [None] * batch.num_rows if cut else batch.column("sections").to_pylist()
            for text, own in zip(batch.column(column).to_pylist(), given, strict=True):
                data = (text or "").encode()
                ids, edges = token_edges(text or "", tokens)
                if cut:
                    starts = cut(data)
                    begins, ends, own_names = starts[:-1], starts[1:], [None] * (len(starts) - 1)
                else:
                    own = [x for x in own or [] if x and x["start"] is not None and x["end"] is not None]
                    begins, ends = (in_bytes(data, np.array([x[c] for x in own], np.int64)) for c in ("start", "end"))
                    own_names = [x["name"] for x in own]
                got, crossing = held(edges, begins, ends, rule)
                totals.append(len(ids))
                names.append(own_names)
                counts.append(got)
                crossings.append(crossing)
            arrays = [batch.column(key), pa.array(totals, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.float64())), pa.array(crossings, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n_tokens", "names", "tokens", "crossing"])

    wanted = [F.col(key), F.col(column)] + ([] if cut else [F.col(sections).alias("sections")])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(*wanted).mapInArrow(run, f"{key} {kind}, n_tokens long, names array<string>, tokens array<double>, crossing array<long>")


def with_sections(docs: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a column sections from a table of key, name, start, end; a document without one has none."""
    lists = sections.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("found"))
    ordered = F.transform("found", lambda x: F.struct(x["name"].alias("name"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    return docs.join(lists.select(key, ordered.alias("sections")), key, "left")


def op9_section_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document: the counts in order, joined by commas; they add up to n_tokens."""
    import public_tokenizers

    tokens = ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = attribute(table(spark, sf_dir, "documents"), tokens, line_starts)
    whole = F.transform("tokens", lambda x: x.cast("long"))
    return found.select("doc_id", "n_tokens", F.size("tokens").cast("long").alias("n_lines"), F.aggregate("crossing", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_crossing"), F.array_join(whole, ",").alias("line_tokens"))
