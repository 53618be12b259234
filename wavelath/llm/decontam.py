"""Benchmark decontamination by templates.

Texts and benchmark items are canonicalised: numbers, names and units become
typed placeholders, other words their lower-case form without signs around
them. Windows of canonical words are hash-joined with the benchmark's windows,
so an item whose numbers or names were changed still meets its template. Along
each alignment of a document with an item, the values that stand in the slots
must agree: the same value of the item always became the same value in the
document, and different values of the same type stayed different. An alignment
counts where the consistent windows cover enough of the item's words.

A name is a capitalised word, so that no list of names is needed. One that begins
the text, a line or a sentence may be a name or not: windows with such words are
read both ways, as words and as names, on either side, and an alignment is judged
under each reading apart. A single letter, and "in", are units only behind a
number.

Items of one template, with equal values in the same slots, are one class: windows
are joined with the class, values are those of its smallest item_id, and a match
names that item and how many the class has.

A window with few words that are no placeholders says little as a template. Such
a window of an item is compared word for word instead, and as a template it is
made longer until it holds enough other words, up to max_window words. Items shorter
than a window need half of their words so, three at least. An item without that
many other words matches word for word only.

The benchmark decides which windows of a document are worth a row: a bitmap of
fixed size over the benchmark's window hashes lets through all true matches and
few others; the join then decides. Nothing else about the benchmark leaves its
table.

Null texts and texts without words match nothing. Items of fewer words than a
window are one window, and match that many words. Rows without a doc_id or an
item_id are compared too; matches are reported under a null id. Repeated rows
count once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, packed, pieces, stage_table, table

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th)?$")
#: Number words and unit names that count as placeholders.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent % mph kmh kph hz khz mhz ghz w kw mw j kj v a k kb mb gb tb meter meters metre metres celsius fahrenheit degree degrees".split())
NUM, UNIT, NAME = 1, 2, 3
#: Units that are also other words: only behind a number.
DOUBTFUL = frozenset(x for x in UNITS if len(x) == 1 and x.isalpha()) | {"in"}
PLACEHOLDERS = dict.fromkeys(UNITS - DOUBTFUL, UNIT) | dict.fromkeys(NUMBER_WORDS, NUM)
#: What a number can begin with, and the empty word.
NUMBER_BEGINS = frozenset(["", *"0123456789+-$€£%"])
STRIP = "\"'“”‘’«»()[]{}<>.,;:!?¿¡*_#|~`…—–-"
ENDS = ".!?:|…"


@dataclass(frozen=True)
class Decontaminator:
    window: int = 8
    #: Words of a window that are not placeholders, at least.
    literals: int = 4
    #: Longest template that a window with too few of them becomes.
    max_window: int = 16
    #: Shortest item that is compared word for word; shorter ones are a bare number or two.
    exact_words: int = 3
    #: Share of an item's words that consistent windows must cover.
    coverage: float = 0.5
    map_bits: int = 1 << 24


class Canon(dict):
    """Numbers of raw words, and by number: hash of the canonical form, hash of the word itself, type, whether capitalised, whether it ends a sentence, whether a unit behind a number, value."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[tuple] = []
        self.values: list[str] = []
        self.hashes, self.exact, self.kinds, self.capital, self.ends, self.doubtful = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int8, bool, bool, bool))

    def __missing__(self, raw: str) -> int:
        bare = raw.strip(STRIP)
        low = bare.lower()
        if bare[:1] in NUMBER_BEGINS:
            kind = NUM if NUMBER.match(bare) else PLACEHOLDERS.get(low, 0)
        else:
            kind = PLACEHOLDERS.get(low, 0)
        capital = not kind and bare[:1].isupper() and (len(bare) == 1 or not bare.isupper())
        own = low.encode()
        self.new.append((xxhash.xxh3_64_intdigest(b"\0%d" % kind if kind else own) if bare or kind else 0, xxhash.xxh3_64_intdigest(b"\1" + own), kind, capital, raw[-1] in ENDS, low in DOUBTFUL))
        found = len(self.values)
        self.values.append(low)
        self[raw] = found
        return found

    def settle(self) -> None:
        """Puts the words met since the last call into the arrays."""
        if self.new:
            columns = zip(*self.new, strict=True)
            olds = self.hashes, self.exact, self.kinds, self.capital, self.ends, self.doubtful
            self.hashes, self.exact, self.kinds, self.capital, self.ends, self.doubtful = (np.concatenate([old, np.array(c, old.dtype)]) for old, c in zip(olds, columns, strict=True))
            self.new = []


#: Of a window: its doubtful words are read as words, as names, or there are none.
AS_WORDS, AS_NAMES, PLAIN = 0, 1, 2
NAME_HASH, UNIT_HASH = (np.uint64(xxhash.xxh3_64_intdigest(b"\0%d" % kind)) for kind in (NAME, UNIT))


def canonical(texts: list[str], words: Canon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, types and numbers of the texts' canonical words one after another, whose they are, and which may be names though they begin something; words of signs alone are left out."""
    if len(words) > 300_000:  # bounds the memory
        words.forget()
    lines = [line.split() for text in texts for line in text.split("\n")]
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(lines)), np.int64)
    words.settle()
    sizes = np.fromiter(map(len, lines), np.int64)
    owner = np.repeat(np.repeat(np.arange(len(texts)), [text.count("\n") + 1 for text in texts]), sizes)
    begins = np.zeros(len(ids) + 1, bool)
    begins[1:] = words.ends[ids]
    begins[np.concatenate([[0], np.cumsum(sizes)])] = True
    hashes, kinds = words.hashes[ids], words.kinds[ids]
    name = words.capital[ids] & ~begins[:-1]
    kinds[name], hashes[name] = NAME, NAME_HASH
    full = hashes != 0
    hashes, kinds, ids, owner, begins = hashes[full], kinds[full], ids[full], owner[full], begins[:-1][full]
    unit = words.doubtful[ids] & ~begins
    unit[:1] = False
    unit[1:] &= (kinds[:-1] == NUM) & (owner[1:] == owner[:-1])
    kinds[unit], hashes[unit] = UNIT, UNIT_HASH
    return hashes, kinds, ids, owner, begins & words.capital[ids] & (kinds == 0)


def enough(size: int, settings: Decontaminator) -> int:
    """How many words of a window must be no placeholders."""
    return settings.literals if size >= settings.window else min(settings.literals, size, max(3, -(-size // 2)))


def windows(kinds: np.ndarray, owner: np.ndarray, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows inside one text, and whether each has enough words that are no placeholders."""
    if len(kinds) < size:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    plain = np.concatenate([[0], np.cumsum(kinds == 0)])
    at = np.flatnonzero(owner[size - 1 :] == owner[: len(owner) - size + 1])
    return at, plain[at + size] - plain[at] >= literals


def extended(kinds: np.ndarray, owner: np.ndarray, at: np.ndarray, settings: Decontaminator) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with too few words that are no placeholders: places and sizes of the longer ones that have enough."""
    plain = np.concatenate([[0], np.cumsum(kinds == 0)])
    size = np.searchsorted(plain, plain[at] + settings.literals) - at
    fits = (size <= settings.max_window) & (at + size <= len(kinds))
    at, size = at[fits], size[fits]
    own = owner[at + size - 1] == owner[at]
    return at[own], size[own]


def named(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix64(out ^ hashes[at + k])
    return out


SLOTS = "array<struct<type:int,at:int,value:string,same:int>>"
WINDOW = f"place int, words int, hash long, size int, reading int, class long, slots {SLOTS}"
SLOT_TYPE = pa.list_(pa.struct([("type", pa.int32()), ("at", pa.int32()), ("value", pa.string()), ("same", pa.int32())]))


def template_class(names: np.ndarray, kinds: np.ndarray, values: list[str], exact: np.ndarray | None) -> tuple[int, list[int]]:
    """A digest of an item's template and of which of its slots have equal values, and of its words too, where some of its windows are compared word for word; and for each place the first one with an equal value."""
    seen: dict[tuple[int, str], int] = {}
    same = [seen.setdefault((k, v), place) if k else place for place, (k, v) in enumerate(zip(kinds.tolist(), values, strict=True))]
    found = xxhash.xxh3_64(names.tobytes() + np.array(same, np.int64).tobytes())
    if exact is not None:
        found.update(exact.tobytes())
    return int(np.uint64(found.intdigest()).view(np.int64)), same


def window_rows(rows_of: DataFrame, key: str, settings: Decontaminator, sizes: list[int], bitmap=None) -> DataFrame:
    """Each window of each text: key, place, words (of the text), hash, size, reading, class, slots (type, offset in the window, value).

    With a bitmap, the windows of all sizes that it lets through; without one, those of settings.window, or of the whole text if that is shorter, and
    longer ones where these hold too few words that are no placeholders, and the class of the text's template. Slots of windows compared word for word are numbers only: these need no context.
    """

    def run(batches):
        words = Canon()
        mask = None if bitmap is None else bitmap.value
        for batch in pieces(batches, 128):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            hashes, kinds, ids, owner, doubtful = canonical(texts, words)
            lengths = np.bincount(owner, minlength=len(texts))
            first = np.cumsum(lengths) - lengths
            own = np.minimum(lengths, settings.window)
            keys, rows = batch.column(key).to_pylist(), []
            exact_hashes = words.exact[ids]
            names, types = np.where(doubtful, NAME_HASH, hashes), np.where(doubtful, NAME, kinds).astype(kinds.dtype)
            open_ = np.concatenate([[0], np.cumsum(doubtful)])
            word_for_word = np.zeros(len(texts), bool)
            groups = []  # size, reading, hashes, types, places
            for size in sizes if mask is not None else np.unique(own[own > 0]).tolist():
                for given, typed, as_names in ((hashes, kinds, False), (names, types, True)):
                    at, full = windows(typed, owner, size, enough(size, settings))
                    if mask is None:
                        whole = own[owner[at]] == size
                        at, full = at[whole], full[whole]
                        if size == settings.window:
                            more, longer = extended(typed, owner, at[~full], settings)
                            groups += [(n, as_names, given, typed, more[longer == n]) for n in np.unique(longer).tolist()]
                    groups.append((size, as_names, given, typed, at[full]))
                    if not as_names and settings.exact_words <= size <= settings.window:
                        groups.append((size, False, exact_hashes, np.where(kinds == NUM, kinds, 0), at[~full]))
                        word_for_word[owner[at[~full]]] = True
            if mask is None:
                classes = [template_class(names[a : a + n], types[a : a + n], [words.values[i] for i in ids[a : a + n]], exact_hashes[a : a + n] if w else None) for a, n, w in zip(first.tolist(), lengths.tolist(), word_for_word.tolist(), strict=True)]
            for size, as_names, given, typed, at in groups:
                doubt = open_[at + size] > open_[at]
                if as_names:  # without a doubtful word it is the window of the other reading
                    at, doubt = at[doubt], doubt[doubt]
                found = named(given, at, size)
                if mask is None:
                    hit = slice(None)
                else:
                    bit = found % np.uint64(settings.map_bits)
                    hit = mask[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                reading = np.where(doubt, AS_NAMES if as_names else AS_WORDS, PLAIN)
                for a, h, r in zip(at[hit].tolist(), found[hit].view(np.int64).tolist(), reading[hit].tolist(), strict=True):
                    k = owner[a]
                    own_class, same = classes[k] if mask is None else (None, None)
                    slots = [{"type": int(typed[a + j]), "at": j, "value": words.values[ids[a + j]], "same": same[a - first[k] + j] if same else None} for j in np.flatnonzero(typed[a : a + size]).tolist()]
                    rows.append((keys[k], int(a - first[k]), int(lengths[k]), h, size, r, own_class, slots))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types_ = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), SLOT_TYPE]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], [key, "place", "words", "hash", "size", "reading", "class", "slots"])

    return rows_of.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, {WINDOW}")


def item_windows(benchmark: DataFrame, settings: Decontaminator) -> tuple[DataFrame, DataFrame]:
    """Windows of the classes of items (class, hash, size, item_reading, item_place, item_words, item_slots), and of each class its smallest item_id and the number of its items."""
    rows = stage_table(window_rows(benchmark.filter("text IS NOT NULL"), "item_id", settings, []), "items")
    classes = rows.groupBy("class").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("items"))
    # items of a class have windows alike at the same places: those of one stand for all, but words that may be names differ
    one = rows.groupBy("class", "hash", "size", "reading", "place").agg(F.min_by(F.struct("words", "slots"), F.coalesce("item_id", F.lit((1 << 63) - 1))).alias("w"))
    return one.select("class", "hash", "size", F.col("reading").alias("item_reading"), F.col("place").alias("item_place"), F.col("w.words").alias("item_words"), F.col("w.slots").alias("item_slots")), classes


def matches(docs: DataFrame, benchmark: DataFrame, settings: Decontaminator = Decontaminator()) -> DataFrame:
    """A row for each document and class of items that it holds: doc_id, item_id (the smallest of the class), items (of the class), coverage, windows, first_word, changed (slots whose value is none of an item met there)."""
    spark = docs.sparkSession
    items, classes = item_windows(benchmark, settings)
    items = stage_table(items, "item_windows")
    bits = items.select(F.pmod("hash", F.lit(settings.map_bits)).alias("bit"), "size")
    # at most a row for each byte of the map, and one for each size up to a window
    filled = bits.groupBy(F.floor(F.col("bit") / 8).alias("byte")).agg(F.expr("bit_or(shiftleft(1, int(bit % 8)))").alias("mask")).toPandas()
    sizes = sorted(r["size"] for r in bits.select("size").distinct().collect())
    mask = np.zeros(settings.map_bits // 8, np.uint8)
    mask[filled["byte"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).astype(np.uint8)
    rows = window_rows(docs, "doc_id", settings, sizes, spark.sparkContext.broadcast(mask)).drop("class")
    # a window that either side reads as names belongs to that reading, one that nothing is doubtful in to both
    reading = F.when((F.col("reading") == AS_NAMES) | (F.col("item_reading") == AS_NAMES), F.array(F.lit(AS_NAMES))).when((F.col("reading") == PLAIN) & (F.col("item_reading") == PLAIN), F.array(F.lit(AS_WORDS), F.lit(AS_NAMES))).otherwise(F.array(F.lit(AS_WORDS)))
    met = stage_table(rows.join(items, ["hash", "size"]).withColumn("reading", F.explode(reading)).drop("item_reading"), "met")  # several aggregations read it
    # along one alignment a document's word stands at a fixed distance from the item's
    met = met.withColumn("shift", F.col("place") - F.col("item_place"))
    pair = F.arrays_zip(F.col("slots"), F.col("item_slots"))
    slot = F.explode_outer(F.transform(pair, lambda x: F.struct(x["item_slots"]["type"].alias("type"), (F.col("item_place") + x["item_slots"]["at"]).alias("at"), x["item_slots"]["same"].alias("old"), x["slots"]["value"].alias("new"), (x["item_slots"]["value"] == x["slots"]["value"]).alias("kept"))))
    key = ["doc_id", "class", "shift", "reading"]
    slots = met.select(*key, slot.alias("s")).filter("s IS NOT NULL").select(*key, "s.*").groupBy(*key, "type", "at", "old", "new").agg(F.max("kept").alias("kept"))
    forward = slots.groupBy(*key, "type", "old").agg(F.countDistinct("new").alias("n"))
    backward = slots.groupBy(*key, "type", "new").agg(F.countDistinct("old").alias("n"))
    broken = forward.filter("n > 1").select(*key).unionByName(backward.filter("n > 1").select(*key)).distinct()
    changed = slots.groupBy(*key).agg(F.count_if(~F.col("kept")).alias("changed"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
    aligned = met.groupBy(*key).agg(
        F.collect_set(F.struct("item_place", "size")).alias("spans"), F.max("item_words").alias("item_words"), F.min("place").alias("first_word"), F.countDistinct("place").alias("windows")
    )
    good = aligned.alias("x").join(broken.alias("y"), same, "left_anti")
    good = good.alias("x").join(changed.alias("y"), same, "left").select("x.*", F.coalesce("y.changed", F.lit(0)).alias("changed"))
    # of two readings of one alignment the one with more windows counts, of equal ones that as words
    good = good.groupBy(*key[:3]).agg(F.max_by(F.struct("spans", "item_words", "first_word", "windows", "changed"), F.struct("windows", -F.col("reading"))).alias("best")).select(*key[:3], "best.*")
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.item_place, s.item_place + s.size - 1)))))")
    # an item that a document holds in parts, say with words put in between: the parts' words count together
    parts = good.groupBy("doc_id", "class").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.max("item_words").alias("item_words"), F.sum("windows").alias("windows"), F.min("first_word").alias("first_word"), F.sum("changed").alias("changed")
    )
    found = parts.select("doc_id", "class", F.round(covered / F.col("item_words"), 6).alias("coverage"), *[F.col(c).cast("long").alias(c) for c in ("windows", "first_word", "changed")]).filter(F.col("coverage") >= settings.coverage)
    return found.join(classes, "class").select("doc_id", "item_id", "items", "coverage", "windows", "first_word", "changed")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, settings: Decontaminator = Decontaminator()) -> DataFrame:
    """The rows of docs whose text holds no benchmark item. Rows are told apart by doc_id and text."""
    mark = F.xxhash64("doc_id", "text")
    found = matches(docs.select(mark.alias("doc_id"), "text"), benchmark, settings)
    return packed(docs, mark=mark).join(found.select(F.col("doc_id").alias("mark")).distinct(), "mark", "left_anti").select("row.*")


def op3_template_windows(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
