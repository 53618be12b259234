"""Documents whose sets of n-grams are alike, by partition of the universe and the pigeonhole principle.

Two sets of sizes r <= s that are alike enough differ in few elements: at most
H(r), their sizes and the bound say. Sizes are cut into bands; in a band every
element is hashed to one of H + 1 segments or more, the same for all documents, so
two such sets cannot differ in all segments. A document stands in the index of the
band of its size, and asks there and in every lower band that holds sets it may be
alike to.

First, segments equal in whole are looked up. Documents with equal sets are one
class, and most segments of most classes are their own: these cost nothing. Each
class is held against one other, of the smallest members of its buckets the one that
it meets most often, and a bucket whose members are of one component then is done
with. In a small bucket with several components the members of different ones are
compared.

A large bucket with several components would be the square of its members. Those
outside its largest component ask again, and all of them can be found. Its
members are put in segments anew, smaller ones, and each is allotted, per segment,
nothing, equality (1) or a neighbourhood of one deletion (2): the set there, or
there less one element, is looked up among the sets of others and these less one
element. Where the allotments come to H + 1, a set within H differs by less than
the allotment in some segment, so whichever are chosen no link is missed. Chosen
are those with the fewest answers in all, by counts of all keys: a part that many
members share is left out, and parts that are a document's own answer for it.

A document that has many answers even so asks by segments of one element. There the
two sides count apart: of sizes r and s, alike sets have t elements in common, so
that in one order of all elements, rare ones first, the first common one is among
the first r - t + 1 of the one and the first s - t + 1 of the other. What many
members share stands last in that order, and copies of one text that each differ
from it in their own way no longer meet.

What comes up is decided on the full sets, and links are grouped by union-find.

Null texts, empty texts, and texts without words have no n-grams and link with
nothing. Rows that share a doc_id are held against others each by its own text, and
a link of one is a link of that id. A row without a doc_id takes part under a hash
of its text; its component_id is the smallest doc_id of its component, or null
where that has none. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, lets_through, mix64, pieces, stage_table, table
from .components import components
from .neardup import NearDuplicates, WordHashes, confirmed, node, reported, shingles


@dataclass(frozen=True)
class NGramJoin:
    words: int = 3
    #: Link at 100 * intersection >= percent * union.
    percent: int = 90
    #: Members of a bucket whose components are compared there.
    bucket: int = 16
    #: Segments for each one needed, where deletions are allotted.
    finer: int = 3
    #: Answers of a view, above which its document asks by single elements.
    answers: int = 16
    map_bits: int = 27

    @cached_property
    def edges(self) -> np.ndarray:
        """Smallest set of each band: a quarter more than that of the one before."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * 5 // 4))
        return np.array(out, np.int64)

    @cached_property
    def bounds(self) -> np.ndarray:
        """Elements in which a band's set and a larger one may differ at most."""
        most = np.append(self.edges[1:], self.edges[-1] * 2) - 1
        return (most + most * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1


class Segments:
    """Sets in the segments of their bands: a view is a set as one band sees it, its own or a lower one that holds sets it may be alike to; a higher one too, if larger sets do not ask."""

    def __init__(self, sets: list[np.ndarray], settings: NGramJoin, finer: int, seed: int, higher: bool = False):
        sizes = np.array([len(s) for s in sets], np.int64)
        own = settings.band(sizes)
        low = settings.band(-(-settings.percent * sizes // 100))
        low = np.maximum(low, np.searchsorted(settings.bounds, 1))  # below, only equal sets are alike
        high = settings.band(sizes * 100 // settings.percent) if higher else own
        views = np.where(sizes > 0, np.maximum(high - low + 1, 0), 0)
        self.set = np.repeat(np.arange(len(sets)), views)
        self.band = low[self.set] + np.arange(len(self.set)) - (np.cumsum(views) - views)[self.set]
        self.indexed = self.band == own[self.set]
        self.needed = settings.bounds[self.band] + 1
        self.count = self.needed * finer
        self.begins = np.cumsum(self.count) - self.count
        elements = np.concatenate([np.zeros(0, np.uint64), *[sets[k] for k in self.set]])
        view = np.repeat(np.arange(len(self.set)), sizes[self.set])
        dealt = mix64(elements ^ mix64(self.band.astype(np.uint64) + np.uint64(seed << 20))[view])
        self.segment = self.begins[view] + ((dealt >> np.uint64(32)) * self.count[view].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        self.values = mix64(elements)
        self.sums = np.zeros(int(self.count.sum()), np.uint64)
        np.add.at(self.sums, self.segment, self.values)
        self.view = np.repeat(np.arange(len(self.set)), self.count)
        place = np.arange(len(self.sums)) - self.begins[self.view]
        self.tags = mix64((self.band[self.view] << 32 | place).astype(np.uint64))

    def keys(self) -> np.ndarray:
        """The key of each segment's elements."""
        return mix64(self.sums ^ self.tags)

    def less_one(self) -> np.ndarray:
        """For each element, the key of its segment without it."""
        return mix64(self.sums[self.segment] - self.values ^ self.tags[self.segment])


def partitioned(docs: DataFrame, settings: NGramJoin) -> DataFrame:
    """Per row: doc_id, node, n_shingles, name (a digest of the set; null without n-grams), and the segments' keys in its own band and in lower ones."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 256):
            sets = [shingles(t, settings.words, hashes) for t in batch.column("text").to_pylist()]
            parts = Segments(sets, settings, 1, 0)
            keys = parts.keys().view(np.int64)
            own = [keys[:0]] * len(sets)
            lower = [[keys[:0]] for _ in sets]
            for k, begin, count, indexed in zip(parts.set.tolist(), parts.begins.tolist(), parts.count.tolist(), parts.indexed.tolist(), strict=True):
                if indexed:
                    own[k] = keys[begin : begin + count]
                else:
                    lower[k].append(keys[begin : begin + count])
            arrays = [
                batch.column("doc_id"),
                batch.column("node"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(own, pa.list_(pa.int64())),
                pa.array([np.concatenate(x) for x in lower], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "n_shingles", "name", "own", "lower"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("node"), "text").mapInArrow(run, "doc_id long, node long, n_shingles long, name binary, own array<long>, lower array<long>")


def key_rows(classes: DataFrame, mask=None, bits: int = 0) -> DataFrame:
    """Rows (key, node, indexed) of classes (node, own, lower), those that a bitmap of keys lets through."""

    def run(batches):
        for batch in pieces(batches, 1024):
            for column, indexed in (("own", True), ("lower", False)):
                lists = batch.column(column)
                keys = lists.flatten().to_numpy(zero_copy_only=False)
                nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
                if mask is not None:
                    hit = lets_through(mask.value, bits, keys.view(np.uint64))
                    keys, nodes = keys[hit], nodes[hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(np.full(len(keys), indexed))], ["key", "node", "indexed"])

    return classes.select("node", "own", "lower").mapInArrow(run, "key long, node long, indexed boolean")


def keys_map(keys: DataFrame, settings: NGramJoin) -> tuple:
    """A bitmap of keys of 64 bits, with a few bits for each and settings.map_bits at most."""
    bits = max(15, min(settings.map_bits, (32 * keys.count()).bit_length()))
    return bitmap(keys.select(F.shiftrightunsigned("key", 64 - bits).alias("cell")), bits, bits)


def bucketed(classes: DataFrame, settings: NGramJoin) -> DataFrame:
    """key, node, indexed, first (the smallest indexed node), size: the members of every key that an indexed node shares with another one."""
    indexed = F.when(F.col("indexed"), F.col("node"))
    ends = key_rows(classes).groupBy("key").agg(F.min(indexed).alias("first"), F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
    shared = stage_table(ends.filter("first IS NOT NULL AND low < high").select("key", "first", "size"), "shared")
    # keys of one document alone need not be shuffled again
    return stage_table(key_rows(classes, *keys_map(shared, settings)).join(shared, "key"), "buckets")


def in_order(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct()


def members_of(docs: DataFrame, buckets: DataFrame, settings: NGramJoin) -> DataFrame:
    """node, text of the documents in buckets, and of a few others: a bitmap chooses them where they are read, so that no other text is shuffled."""
    key = F.xxhash64("node")
    mask, bits = keys_map(buckets.select(key.alias("key")).distinct(), settings)

    def run(batches):
        for batch in pieces(batches):
            hit = lets_through(mask.value, bits, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit)).select(["node", "text"])

    rows = docs.select(node().alias("node"), "text").withColumn("key", F.coalesce(key, F.lit(0).cast("long")))
    return stage_table(rows.mapInArrow(run, "node long, text string"), "members")


def cheapest(once: np.ndarray, twice: np.ndarray, needed: int) -> np.ndarray:
    """An allotment (0, 1 or 2 for each segment) that comes to needed, of the smallest sum of costs: once for a 1, twice for a 2."""
    free = np.where(twice == 0, 2, np.where(once == 0, 1, 0)).astype(np.int8)
    if free.sum() >= needed:
        return free
    best = np.full(needed + 1, np.inf)  # of what comes to so much at least
    best[0] = 0
    one = np.maximum(np.arange(needed + 1) - 1, 0)
    two = np.maximum(one - 1, 0)
    took = np.zeros((len(once), needed + 1), np.int8)
    for k in range(len(once)):
        choices = np.stack([best, best[one] + once[k], best[two] + twice[k]])
        took[k] = choices.argmin(axis=0)
        best = choices.min(axis=0)
    out, at = np.zeros(len(once), np.int8), needed
    for k in range(len(once) - 1, -1, -1):
        out[k] = took[k, at]
        at = max(0, at - int(out[k]))
    return out


ENTRY = "role int, key long, node long, component long, mark long, band int, segment int, needed int, segments int"


def entries(texts: DataFrame, settings: NGramJoin, mask=None, bits: int = 0) -> DataFrame:
    """Of texts (node, component, asks, mark, text): keys to be found under (role 0), and asked for if asks: equality (1), a set among sets less one (2), a set less one among sets (3); those that a bitmap lets through."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 64):
            nodes, components, asks, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "asks", "mark"))
            parts = Segments([shingles(t, settings.words, hashes) for t in batch.column("text").to_pylist()], settings, settings.finer, 1, True)
            whole, less, every = parts.keys(), parts.less_one(), np.arange(len(parts.sums))
            found, asked = mix64(less), mix64(whole)  # sets less one are found under keys of their own
            rows = []
            for role, keys, segment in ((0, whole, every), (0, found, parts.segment), (1, whole, every), (2, asked, every), (3, less, parts.segment)):
                held = (parts.indexed if role == 0 else asks[parts.set])[parts.view[segment]]
                if mask is not None:
                    held = held & lets_through(mask.value, bits, keys)
                rows.append((np.full(int(held.sum()), role, np.int32), keys[held], segment[held]))
            role, keys, segment = (np.concatenate(c) for c in zip(*rows, strict=True))
            view = parts.view[segment]
            of = parts.set[view]
            own = [parts.band[view], segment - parts.begins[view], parts.needed[view], parts.count[view]]
            columns = [role, keys.view(np.int64), nodes[of], components[of], marks[of], *[c.astype(np.int32) for c in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["role", "key", "node", "component", "mark", "band", "segment", "needed", "segments"])

    return texts.select("node", "component", "asks", "mark", "text").mapInArrow(run, ENTRY)


#: Documents that have an element, from so many on: places in the order of elements.
LEVELS = (2, 8, 32, 128, 512)


def single(texts: DataFrame, dear: DataFrame, settings: NGramJoin) -> DataFrame:
    """Pairs (a, b) of different components, one of them among dear (node, mark), whose rarest elements meet: all alike ones are among them. texts: node, component, mark, text."""

    def elements(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 64):
            found = [shingles(t, settings.words, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(mix64(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64))], ["key"])

    counts = stage_table(texts.mapInArrow(elements, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEVELS[0]), "counts")
    maps = [keys_map(counts.filter(F.col("n") >= n), settings) for n in LEVELS]

    def rarest(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 64):
            out = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = mix64(shingles(text, settings.words, hashes))
                level = sum(lets_through(mask.value, bits, own).astype(np.int8) for mask, bits in maps)
                order = np.lexsort((own, level))[: len(own) + settings.percent * len(own) // -100 + 1 if len(own) else 0]
                place = np.flatnonzero(level[order] > 0)  # what no other document has is only counted
                out.append((np.full(len(place), k), own[order[place]], place, np.full(len(place), len(own))))
            of, keys, place, size = (np.concatenate(c) for c in zip(*out, strict=True))
            columns = [*(batch.column(c).take(pa.array(of)) for c in ("node", "component", "mark")), *(pa.array(c.astype(np.int64)) for c in (place, size))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *columns], ["key", "node", "component", "mark", "place", "size"])

    rows = stage_table(texts.select("node", "component", "mark", "text").mapInArrow(rarest, "key long, node long, component long, mark long, place long, size long"), "rarest")
    asked = rows.join(dear, ["node", "mark"], "left_semi").selectExpr("key", "node r", "component cr", "place pr", "size nr")
    answers = rows.selectExpr("key", "node s", "component cs", "place ps", "size ns")
    less = 100 + settings.percent
    common = f"({settings.percent} * (nr + ns) + {less - 1}) div {less}"
    return asked.join(answers, "key").filter(f"cr <> cs AND pr <= nr - {common} AND ps <= ns - {common}").select("r", "s")


def allotted(texts: DataFrame, settings: NGramJoin) -> DataFrame:
    """Pairs (a, b) of different components that meet where the allotment of one says so, or its rarest elements: each pair within the bound, of which one asks, is among them. texts: node, component, asks, text."""
    texts = texts.withColumn("mark", F.xxhash64("text"))
    held, asking = (F.when(F.expr(which), F.col("component")) for which in ("role = 0", "role > 0"))
    ends = entries(texts, settings).groupBy("key").agg(F.min(held).alias("a"), F.max(held).alias("b"), F.min(asking).alias("c"), F.max(asking).alias("d"), F.count(held).alias("n"))
    # keys under which one component asks for what another one has
    kept = stage_table(ends.filter("a IS NOT NULL AND c IS NOT NULL AND (a <> b OR c <> d OR a <> c)").select("key", "n"), "answers")
    rows = stage_table(entries(texts, settings, *keys_map(kept, settings)).join(kept, "key"), "entries")
    asked = rows.filter("role > 0")
    # answers are those of other components
    same = rows.filter("role = 0").groupBy("key", "component").agg(F.count("*").alias("same"))
    asked = asked.join(same, ["key", "component"], "left").withColumn("n", F.col("n") - F.coalesce("same", F.lit(0)))
    view = ["node", "mark", "band"]
    costs = asked.groupBy(*view, "needed", "segments", "segment").agg(F.sum(F.when(F.col("role") == 1, F.col("n")).otherwise(0)).alias("once"), F.sum("n").alias("twice"))
    by_view = costs.groupBy(*view, "needed", "segments").agg(F.collect_list(F.struct("segment", "once", "twice")).alias("costs"))

    def choose(batches):
        for batch in pieces(batches, 1024):
            out = []
            for *at, needed, segments, costs in zip(*(batch.column(c).to_pylist() for c in (*view, "needed", "segments", "costs")), strict=True):
                once, twice = np.zeros(segments), np.zeros(segments)
                for c in costs:
                    once[c["segment"]], twice[c["segment"]] = c["once"], c["twice"]
                power = cheapest(once, twice, needed)
                if np.choose(power, (0, once, twice)).sum() > settings.answers:
                    out.append((*at, -1, 0))
                    continue
                out += [(*at, k, int(power[k])) for k in np.flatnonzero(power).tolist() if twice[k]]
            columns = zip(*out, strict=True) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*view, "segment", "power"])

    chosen = stage_table(by_view.mapInArrow(choose, "node long, mark long, band int, segment int, power int"), "chosen")
    dear = chosen.filter("segment < 0").select("node", "mark").distinct()
    found = asked.filter("n > 0").select("role", "key", "component", *view, "segment").join(chosen, [*view, "segment"]).filter("role = 1 OR power = 2").select("key", F.col("node").alias("s"), F.col("component").alias("cs"))
    answers = rows.filter("role = 0").select("key", F.col("node").alias("r"), F.col("component").alias("cr"))
    met = found.distinct().join(answers, "key").filter("cr <> cs").select("r", "s")
    return in_order(met.unionByName(single(texts, dear, settings)), "r", "s")


def joined(docs: DataFrame, settings: NGramJoin = NGramJoin()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    exact = NearDuplicates(words=settings.words, percent=settings.percent)
    rows = stage_table(partitioned(docs, settings), "sets")
    firsts = stage_table(rows.filter("name IS NOT NULL").groupBy("name").agg(F.min("node").alias("node"), F.min("doc_id").alias("least")), "firsts")
    classes = stage_table(rows.join(firsts.select("name", "node"), ["name", "node"]).dropDuplicates(["name", "node"]).select("node", "own", "lower"), "classes")
    buckets = bucketed(classes, settings)
    texts = members_of(docs, buckets, settings)

    met = buckets.filter("node <> first").groupBy("node", "first").count()
    nearest = met.groupBy("node").agg(F.max_by("first", F.struct(F.col("count"), -F.col("first"))).alias("nearest"))
    links = stage_table(confirmed(in_order(nearest, "nearest", "node"), texts, exact), "links")
    labels = stage_table(components(links), "labels")

    # buckets with several components
    named = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    members = stage_table(named.join(open_, "key"), "open")
    small = members.filter(F.col("size") <= settings.bucket)
    left = small.filter("indexed").selectExpr("key", "node r", "component cr")
    crossing = left.join(small.selectExpr("key", "node s", "component cs"), "key").filter("cr <> cs")
    large = members.filter(F.col("size") > settings.bucket)
    main = large.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    roles = large.join(main, "key").groupBy("node").agg(F.max(F.col("component") != F.col("main")).alias("asks"), F.first("component").alias("component"))
    asked = stage_table(texts.join(roles, "node"), "asked")
    more = stage_table(in_order(crossing, "r", "s").unionByName(allotted(asked, settings)).distinct(), "more")
    labels = components(links.unionByName(stage_table(confirmed(more, texts, exact), "confirmed")))
    return reported(rows, firsts, labels).select("doc_id", "n_shingles", "component_id")


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
