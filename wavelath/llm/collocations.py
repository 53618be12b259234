"""Phrases that occur far more often than their parts would make them meet, by language.

Texts are cut at signs into pieces, and pieces into words. Which phrases are worth
counting is found from above, with sketches: a sketch is a table of cells, each the
sum of what falls into it, so that a cell's count is at least that of any phrase in
it. Words are counted, then pairs of frequent words in a sketch that has several
cells for each word of the corpus. Only stretches of words in which every pair may
be frequent can hold a frequent phrase. A second sketch, of their longer phrases,
leaves the longest windows that may be frequent; equal ones are one row with a
count, what two neighbouring ones share counts below zero, and from here on they
stand for the corpus: there are no more of them than of phrases that may be
frequent, however long stretches are. A third sketch leaves the candidates.

Candidates are dealt out by their first two words into shards of bounded size, and
a shard is compiled into an automaton. A stretch is sent to the shards of its own
pairs of words, where the automaton reports every occurrence, those that overlap
too; blanks on both sides of phrases and stretches keep matches to whole words. A
shard that many stretches meet is dealt out again, with a copy of its candidates
for each part. Sums over parts are exact counts, and the thresholds see only these.

Pairs of words that may be frequent are known to tasks as a bitmap of fixed size:
it lets through all of them and few others.

A null language is "und". Null texts, and texts without words, add nothing. Rows
count as often as they stand there, whatever their ids and other columns are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, lets_through, mix64, pieces, stage_table, table

#: Signs that end a piece.
SIGNS = b".,;:!?\n\x0b\x0c\r"
CUT = b"\xff"  # in no UTF-8 text
FORMS = bytes(CUT[0] if c in SIGNS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Collocations:
    #: A phrase is counted with so many occurrences, and has so many words at most.
    least: int = 100
    max_words: int = 5
    #: A phrase goes where a longer one has so many per cent of its occurrences.
    percent: int = 100
    #: Best phrases of each language.
    best: int = 2000
    #: Cells of a sketch for each word of the corpus.
    cells: int = 4
    map_bits: int = 27
    #: Bytes of a shard's candidates, and stretches that meet one automaton.
    shard_bytes: int = 1 << 21
    part_rows: int = 400_000


def words_of(texts: list[str]) -> list[bytes]:
    """The words of texts, with CUT between pieces and at both ends."""
    joined = CUT.join(t.encode() for t in texts).translate(FORMS)
    return (b" \xff " + joined.replace(CUT, b" \xff ") + b" \xff ").split()


def by_language(batch: pa.RecordBatch) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if text:
            out.setdefault(lang, []).append(text)
    return out


def tally(counts: dict[str, Counter], name: str) -> pa.RecordBatch:
    """Counts by language as rows."""
    langs, words, n = [], [], []
    for lang, own in counts.items():
        langs += [lang] * len(own)
        words += [w.decode() for w in own]
        n += own.values()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", name, "n"])


def tallies(batches, name: str, of, most: int = 300_000):
    """Rows of what of() counts in each batch, added up over batches while that takes little memory."""
    counts: dict[str, Counter] = {}
    for batch in pieces(batches):
        for lang, texts in by_language(batch).items():
            counts.setdefault(lang, Counter()).update(of(lang, texts))
        if sum(map(len, counts.values())) > most:
            yield tally(counts, name)
            counts = {}
    yield tally(counts, name)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs."""

    def run(batches):
        def of(lang, texts):
            own = Counter(words_of(texts))
            del own[CUT]
            return own

        yield from tallies(batches, "word", of)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Hashes(dict):
    """Hashes of words of one language by word; 0 for a word that a bitmap does not let through, and between pieces."""

    def __init__(self, lang: str, mask: np.ndarray | None, bits: int):
        self.seed, self.mask, self.bits = xxhash.xxh3_64_intdigest(lang.encode()), mask, bits

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        if word == CUT or self.mask is not None and not self.mask[(at := found >> 64 - self.bits) >> 3] >> (at & 7) & 1:
            found = 0
        self[word] = found
        return found


class Languages(dict):
    """Hashes by language, for the words that a task meets again."""

    def hashes(self, lang: str, tokens: list[bytes], mask: np.ndarray | None = None, bits: int = 0) -> np.ndarray:
        own = self.get(lang)
        if own is None:
            if len(self) > 8:
                self.clear()
            own = self[lang] = Hashes(lang, mask, bits)
        return np.fromiter(map(own.__getitem__, tokens), np.uint64, len(tokens))


def window_keys(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of words that all have a hash, and their places."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - size + 1
    full = hashes[:count] != 0
    for k in range(1, size):
        full &= hashes[k : k + count] != 0
    at = np.flatnonzero(full)
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix64(out ^ hashes[at + k])
    return out, at


#: Cells of a block of a sketch, in bits, at most: a task holds one block as an array. A sketch has 256 blocks at least.
BLOCK = 21


def block_rows(held: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """Cells and what falls into them, added up: a row for each block of so many bits, of cells (32-bit numbers) and sums (64-bit ones)."""
    cells, weights = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(cells)
    cells = cells[order]
    firsts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weights[order], firsts) if len(cells) else weights
    cells = cells[firsts].view(np.int64)
    blocks = cells >> bits
    edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(cells) else np.zeros(0, np.int64), len(cells))

    def binary(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    return pa.RecordBatch.from_arrays([pa.array(blocks[edges[:-1]]), binary((cells & (1 << bits) - 1).astype("<u4")), binary(sums.astype("<i8"))], ["block", "cells", "sums"])


def sketched(rows: DataFrame, held_of, bits: int, least: int) -> DataFrame:
    """The cells (numbers of so many bits) of a sketch that hold least or more, as rows (cell). held_of: of an Arrow batch of rows, pairs of arrays (cells, what falls into them).

    Tasks add up what they meet by block of cells; a block is then one array that its parts are added to as they come.
    """

    within = max(8, min(BLOCK, bits - 8))

    def parts(batches):
        held, count = [], 0
        for batch in pieces(batches):
            for cells, weights in held_of(batch):
                held.append((cells, weights))
                count += len(cells)
            if count > 1_500_000:
                yield block_rows(held, within)
                held, count = [], 0
        if held:
            yield block_rows(held, within)

    def whole(batches):
        here, sums = None, np.zeros(1 << within, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array((here << within) + np.flatnonzero(sums >= least))], ["cell"])

        for batch in batches:
            for block, cells, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "sums")), strict=True):
                if block != here:
                    if here is not None:
                        yield out()
                    here, sums[:] = block, 0
                sums[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<i8")
        if here is not None:
            yield out()

    return rows.mapInArrow(parts, "block long, cells binary, sums binary").repartition("block").sortWithinPartitions("block").mapInArrow(whole, "cell long")


def frequent_words(words: DataFrame, bits: int) -> DataFrame:
    """Rows (cell) of words (lang, word)."""

    def run(batches):
        for batch in batches:
            keys = [xxhash.xxh3_64_intdigest(w.encode(), xxhash.xxh3_64_intdigest(lang.encode())) or 1 for lang, w in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((np.array(keys, np.uint64) >> np.uint64(64 - bits)).view(np.int64))], ["cell"])

    return words.select("lang", "word").mapInArrow(run, "cell long")


def pair_cells(texts: DataFrame, words, word_bits: int, bits: int, least: int) -> DataFrame:
    """Of a sketch of pairs of neighbouring frequent words, the cells that hold least or more."""

    known = Languages()

    def held_of(batch):
        for lang, own in by_language(batch).items():
            tokens = words_of(own)
            keys, _ = window_keys(known.hashes(lang, tokens, words.value, word_bits), 2)
            yield keys >> np.uint64(64 - bits), np.ones(len(keys), np.int64)

    return sketched(texts, held_of, bits, least)


def stretches(texts: DataFrame, words, word_bits: int, pairs, pair_bits: int) -> DataFrame:
    """lang, stretch, n: the longest stretches of words inside pieces in which every pair may be frequent, and how often each stands there; counted in each task by itself."""

    def run(batches):
        known = Languages()

        def of(lang, texts):
            tokens = words_of(texts)
            keys, at = window_keys(known.hashes(lang, tokens, words.value, word_bits), 2)
            at = at[lets_through(pairs.value, pair_bits, keys)]
            if not len(at):
                return {}
            first = np.append(True, np.diff(at) > 1)
            last = np.append(first[1:], True)
            return Counter(b" ".join(tokens[a : b + 2]) for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True))

        yield from tallies(batches, "stretch", of)

    return texts.mapInArrow(run, "lang string, stretch string, n long")


def tokens_of(batch: pa.RecordBatch, known: Languages):
    """Of a batch of stretches, by language: words with CUT between stretches, hashes, and each word's stretch's count."""
    rows: dict[str, tuple[list, list]] = {}
    for lang, text, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "stretch", "n")), strict=True):
        own = rows.setdefault(lang, ([], []))
        own[0].append(text.encode().split(b" "))
        own[1].append(n)
    for lang, (parts, counts) in rows.items():
        tokens = list(chain.from_iterable((*p, CUT) for p in parts))
        yield lang, tokens, known.hashes(lang, tokens), np.repeat(np.array(counts, np.int64), [len(p) + 1 for p in parts])


def phrase_cells(rows: DataFrame, bits: int, sizes: range, least: int) -> DataFrame:
    """Of a sketch of the stretches' phrases of some sizes, the cells that hold least or more."""

    known = Languages()

    def held_of(batch):
        for _, _, hashes, weights in tokens_of(batch, known):
            for size in sizes:
                keys, at = window_keys(hashes, size)
                yield keys >> np.uint64(64 - bits), weights[at]

    return sketched(rows, held_of, bits, least)


def windows(hashes: np.ndarray, longer, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest windows of 2 to most words that may be frequent, with all windows inside them, as places of first words and behind last ones: none inside another, in order. longer: a bitmap of windows of 3 words and more."""
    _, at = window_keys(hashes, 2)
    size = np.ones(len(hashes) + 1, np.int64)
    size[at] = 2
    for k in range(3, most + 1):
        keys, places = window_keys(hashes, k)
        places = places[lets_through(longer, bits, keys)]
        size[places[size[places] == k - 1]] = k
    for _ in range(most - 2):  # what follows a window's first word may be frequent too
        size[:-1] = np.minimum(size[:-1], size[1:] + 1)
    ends = at + size[at]
    first = np.append(True, ends[1:] > ends[:-1])[: len(at)]
    return at[first], ends[first]


def parts_of(rows: DataFrame, longer, bits: int, settings: Collocations) -> DataFrame:
    """lang, stretch, n: the windows of stretches that may be frequent, and with a count below zero what two neighbouring ones share, so that the counts of what holds a phrase come to its occurrences."""

    def run(batches):
        known, counts = Languages(), {}
        for batch in pieces(batches, 1 << 16):
            for lang, tokens, hashes, weights in tokens_of(batch, known):
                starts, ends = windows(hashes, longer.value, bits, settings.max_words)
                own = counts.setdefault(lang, Counter())
                both = np.flatnonzero(ends[:-1] - starts[1:] >= 2)
                for a, b, n in ((starts, ends, weights[starts]), (starts[both + 1], ends[both], -weights[starts[both]])):
                    for i, j, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
                        own[b" ".join(tokens[i:j])] += k
            if sum(map(len, counts.values())) > 300_000:
                yield tally(counts, "stretch")
                counts = {}
        yield tally(counts, "stretch")

    return rows.mapInArrow(run, "lang string, stretch string, n long").groupBy("lang", "stretch").agg(F.sum("n").alias("n")).filter("n <> 0")


def phrases(rows: DataFrame, mask, bits: int, settings: Collocations) -> DataFrame:
    """lang, phrase: the phrases of stretches that a bitmap lets through."""

    def run(batches):
        met: dict[str, set[bytes]] = {}
        known = Languages()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([lang for lang, own in met.items() for _ in own], pa.string()), pa.array([p.decode() for own in met.values() for p in own], pa.string())], ["lang", "phrase"])

        for batch in pieces(batches, 8192):
            for lang, tokens, hashes, _ in tokens_of(batch, known):
                own = met.setdefault(lang, set())
                for size in range(2, settings.max_words + 1):
                    keys, at = window_keys(hashes, size)
                    own.update(b" ".join(tokens[a : a + size]) for a in at[lets_through(mask.value, bits, keys)].tolist())
            if sum(map(len, met.values())) > 200_000:
                yield out()
                met.clear()
        yield out()

    return rows.mapInArrow(run, "lang string, phrase string").distinct()


def occurrences(rows: DataFrame, candidates: DataFrame, settings: Collocations) -> DataFrame:
    """lang, phrase, n: how often each candidate (lang, phrase) occurs in the stretches (lang, stretch, n)."""
    shards = max(1, -(-(candidates.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0) // settings.shard_bytes))
    shard = lambda a, b: F.pmod(F.xxhash64("lang", a, b), F.lit(shards))
    words = F.split("phrase", " ")
    dealt = candidates.select("lang", shard(words[0], words[1]).alias("shard"), F.col("phrase").alias("text"))
    # each word with the one behind it: the last one has none
    to = F.expr("zip_with(w, slice(w, 2, size(w)), (x, y) -> struct(x, y))")
    sent = rows.select("lang", "stretch", "n", F.split("stretch", " ").alias("w")).select("lang", "stretch", "n", F.filter(to, lambda p: p["y"].isNotNull()).alias("to"))
    sent = sent.select("lang", "stretch", "n", F.array_distinct(F.transform("to", lambda p: shard(p["x"], p["y"]))).alias("to"))
    sent = sent.select("lang", F.explode("to").alias("shard"), F.col("stretch").alias("text"), "n")
    sent = stage_table(sent.join(dealt.select("lang", "shard").distinct(), ["lang", "shard"], "left_semi"), "sent")
    parts = sent.groupBy("lang", "shard").agg(F.ceil(F.count("*") / settings.part_rows).cast("int").alias("parts"))
    asked = sent.join(parts, ["lang", "shard"]).select("lang", "shard", F.pmod(F.xxhash64("text"), "parts").cast("int").alias("part"), "text", "n")
    held = dealt.join(parts, ["lang", "shard"]).select("lang", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text", F.lit(None).cast("long").alias("n"))
    group = ["lang", "shard", "part"]

    def run(batches):
        own, automaton, names, counts = None, None, [], []

        def out():
            found = [(w[1:-1], c) for w, c in zip(names, counts) if c]  # a part that no stretch falls into has no counts
            return pa.RecordBatch.from_arrays([pa.array([own[0]] * len(found), pa.string()), pa.array([w for w, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for *at, text, n in zip(*(batch.column(c).to_pylist() for c in (*group, "text", "n")), strict=True):
                if at != own:
                    if names:
                        yield out()
                    own, automaton, names, counts = at, None, [], []
                if n is None:  # candidates come first
                    names.append(f" {text} ")
                    continue
                if automaton is None:
                    automaton, counts = ahocorasick.Automaton(), [0] * len(names)
                    for k, name in enumerate(names):
                        automaton.add_word(name, k)
                    automaton.make_automaton()
                for _, k in automaton.iter(f" {text} "):
                    counts[k] += n
        if names:
            yield out()

    ordered = held.unionByName(asked).repartition(*group).sortWithinPartitions(*group, "n")
    return ordered.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, settings: Collocations = Collocations()) -> tuple[DataFrame, DataFrame]:
    """Of docs (lang, text): words (lang, word, n) that occur settings.least times, and phrases (lang, phrase, n) of several words that do; exact. A word "" has the number of all words of its language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    # no word is empty: under that name stands the sum
    every = stage_table(word_counts(texts), "words")
    words = stage_table(every.filter(F.col("n") >= settings.least).unionByName(every.groupBy("lang").agg(F.lit("").alias("word"), F.sum("n").alias("n"))), "frequent")
    total = words.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    bits = max(20, (total * settings.cells).bit_length())
    often = F.col("n") >= settings.least
    word_map = bitmap(frequent_words(words.filter("word <> ''"), bits), bits, settings.map_bits)
    pair_map = bitmap(pair_cells(texts, *word_map, bits, settings.least), bits, settings.map_bits)
    rows = stage_table(stretches(texts, *word_map, *pair_map), "stretches")
    if settings.max_words > 2:
        longer = bitmap(phrase_cells(rows, bits, range(3, settings.max_words + 1), settings.least), bits, settings.map_bits)
        rows = stage_table(parts_of(rows, *longer, settings), "parts")
    phrase_map = bitmap(phrase_cells(rows, bits, range(2, settings.max_words + 1), settings.least), bits, settings.map_bits)
    candidates = stage_table(phrases(rows, *phrase_map, settings), "candidates")
    return words, stage_table(occurrences(rows, candidates, settings).filter(often), "phrases")


def first_of(rows: DataFrame, order: list, best: int) -> DataFrame:
    """The first rows of each language, with their rank: chosen inside parts, then inside parts of what is left, so that no task meets all rows of a language."""
    for parts in (64, 8, 1):
        by = ["lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))] if parts > 1 else ["lang"]
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return rows


def collocations(docs: DataFrame, settings: Collocations = Collocations()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score. docs: lang, text."""
    words, found = counted(docs, settings)
    split = F.split("phrase", " ")
    own = found.select("lang", "phrase", F.col("n").alias("a"), split.alias("w"))
    # a phrase inside a longer one with as many occurrences is inside one of a word more with as many
    inner = F.array(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))
    longer = own.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = own.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < settings.percent * F.col("a"), F.lit(True)))
    cut = F.explode(F.expr("transform(sequence(1, size(w) - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS first, array_join(slice(w, k + 1, size(w)), ' ') AS rest))"))
    cuts = kept.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    counts = words.select("lang", F.col("word").alias("part"), "n").filter("part <> ''").unionByName(found.selectExpr("lang", "phrase part", "n"))
    sums = words.filter("word = ''").select("lang", "n")
    scored = cuts.join(counts.selectExpr("lang", "part first", "n l"), ["lang", "first"]).join(counts.selectExpr("lang", "part rest", "n r"), ["lang", "rest"]).join(sums, "lang")
    wide = "CAST(CAST({} AS DECIMAL(19, 0)) * CAST({} AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"
    scored = scored.withColumn("score", F.expr(f"{wide.format('1000 * a', 'n')} div {wide.format('l', 'r')}"))
    low = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    return first_of(low, [F.desc("score"), F.desc("a"), F.asc("phrase")], settings.best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
