"""Near-duplicate documents by SuperMinHash.

A document is the set of its distinct word shingles. Every element of the set
visits the signature's places in an order of its own, with values that rise from
round to round; a place keeps its smallest value, and a document stops as soon
as no later round can lower one. Documents with equal sets are one class. The
signatures are cut into bands; classes that share a band are candidates, an
estimate from the signatures drops hopeless ones, and the full sets decide.
Links are grouped by union-find.

In a band's bucket every member is held against the smallest one, unless the two
are already linked through the smallest member that it meets in most bands.
Where a bucket still has several components after that, the members outside its
largest component are held against all of its members in blocks of bounded size.
So every candidate pair is decided unless it is already linked through others,
and no bucket is gathered whole.

With the default bands a pair at the bound shares none with probability 5e-6,
and the estimate drops it with probability below 1e-6.

Null texts, empty texts, and texts without words have no shingles and link with
nothing. Rows that share a doc_id are held against others each by its own text,
and a link of one is a link of that id. A row without a doc_id takes part under a
64-bit hash of its text; a component is named after its smallest doc_id, whatever
the hashes are, and its component_id is null where no row of it has an id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, packed, pieces, stage_table, table
from .components import components

#: Partners that a member meets in one task.
PARTNERS = 512


@dataclass(frozen=True)
class NearDuplicates:
    words: int = 5
    #: Link at 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 40
    rows: int = 6
    #: Candidates below this estimate are not held against each other in full.
    estimate: float = 0.62
    #: Members of a block in a bucket with several components, and hashes of a member's sketch there.
    block: int = 256
    sketch: int = 1024

    @property
    def places(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z in lower case, words between ASCII blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    count = len(ids) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = mix64(out ^ ids[k : k + count])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A signature for each set: round << 32 | random part; the highest number where the set is empty."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = mix64(np.concatenate([np.zeros(0, np.uint64), *sets]))
    drawn: list[np.ndarray] = []  # where each element's earlier rounds have swapped to
    for j in range(places):
        if not len(owner):
            break
        value = mix64(seeds + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        spot = j + ((value & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        drawn.append(spot)
        place = spot
        for t in range(j - 1, -1, -1):  # the place that the element's permutation has at spot
            place = np.where(place == drawn[t], t, place)
        np.minimum.at(flat, owner * places + place, np.uint64(j) << np.uint64(32) | value >> np.uint64(32))
        going = out.max(axis=1) >= np.uint64(j + 1) << np.uint64(32)  # a later round can still lower a place
        stay = going[owner]
        if not stay.all():
            owner, seeds, drawn = owner[stay], seeds[stay], [d[stay] for d in drawn]
    return out


def signed(docs: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Per row: doc_id, node, n_shingles, name (a digest of the set; null without shingles), bands, and a byte of each place."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 256):
            sets = [shingles(t, settings.words, hashes) for t in batch.column("text").to_pylist()]
            signature = super_minhash(sets, settings.places)
            keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), (len(sets), settings.bands))
            for k in range(settings.rows):
                keys = mix64(keys ^ signature[:, k :: settings.rows])
            light = (mix64(signature) & np.uint64(255)).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            arrays = [
                batch.column("doc_id"),
                batch.column("node"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([k.view(np.int64) if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                pa.array([x.tobytes() if f else None for x, f in zip(light, full, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "n_shingles", "name", "bands", "light"])

    return docs.select("doc_id", node().alias("node"), "text").mapInArrow(run, "doc_id long, node long, n_shingles long, name binary, bands array<long>, light binary")


def node():
    """The id that a row takes part under."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the light signatures, chance agreement of bytes taken out."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def beside(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of both sides as x and y. rows: node and the column.

    A member a with many partners is dealt out over several tasks, each with a copy of its row: one copy for each
    PARTNERS pairs.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(rows.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").join(parts.filter("parts > 1"), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), "parts").cast("int"), F.lit(0)))
    copies = rows.select(F.col("node").alias("a"), F.col(column).alias("x")).join(parts, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(copies, ["a", "part"]).select("a", "b", "x", "y")


def likely(pairs: DataFrame, classes: DataFrame, settings: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""

    def run(batches):
        for batch in pieces(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, settings.places) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(agreeing(x, y) >= settings.estimate))

    return beside(pairs, classes, "light").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, settings: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: node, text."""

    def run(batches):
        hashes, last, left = WordHashes(), None, None
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if last is None or x != last:
                    last, left = x, shingles(x, settings.words, hashes)
                right = shingles(y, settings.words, hashes)
                if not len(left) or not len(right):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= settings.percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # read twice: once to count a member's partners, once to join them
    return beside(stage_table(pairs, "pairs"), texts, "text").mapInArrow(run, "a long, b long")


def sketches(nodes: DataFrame, texts: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Of each node: sketch, the settings.sketch smallest 32-bit hashes of its shingles, the whole set where that is smaller."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches, 128):
            kept = [np.unique((shingles(t, settings.words, hashes) >> np.uint64(32)).astype(np.uint32))[: settings.sketch] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([k.tobytes() for k in kept], pa.binary())], ["node", "sketch"])

    return texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "node long, sketch binary")


def sketched(a: np.ndarray, b: np.ndarray, size: int) -> tuple[float, bool]:
    """Similarity from two sketches, and whether it is that of whole sets."""
    whole = len(a) < size and len(b) < size
    if not len(a) or not len(b):
        return 0.0, whole
    both = np.intersect1d(a, b, assume_unique=True)
    if whole:
        return len(both) / (len(a) + len(b) - len(both)), True
    last = np.sort(np.concatenate([a, np.setdiff1d(b, both, assume_unique=True)]))[: size][-1]
    return float((both <= last).sum()) / min(size, len(a) + len(b) - len(both)), False


def across(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Likely pairs between components inside buckets of three or more, in blocks. buckets: key, node, first, size.

    Blocks hold sketches, on which members are compared where they stand: of the pairs of a member with another component
    the one most alike goes on where whole sets were compared, all that may be linked where they were not.
    """
    named = buckets.filter("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counted = named.groupBy("key", "component").count()
    open_ = (
        counted.groupBy("key")
        .agg(F.count("*").alias("parts"), F.sum("count").alias("size"), F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("largest"))
        .filter("parts > 1")
        .selectExpr("key", "main", f"int(ceil(size / {settings.block}D)) blocks", f"int(ceil((size - largest) / {settings.block}D)) query_blocks")
    )
    members = stage_table(named.join(open_, "key"), "open")
    own = stage_table(sketches(members.select("node").distinct(), texts, settings), "sketches")
    members = members.join(classes.select("node", "light"), "node").join(own, "node")
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    asked = F.pmod(F.xxhash64("node", F.lit(1)), "query_blocks").cast("int")
    row = ["key", "node", "component", "light", "sketch"]
    rows = members.select(*row, mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("asks"), F.lit(False).alias("query")).unionByName(
        members.filter("component <> main").select(*row, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), asked.alias("asks"), F.lit(True).alias("query"))
    )
    blocks = rows.groupBy("key", "block", "asks").agg(F.collect_list(F.struct("query", *row[1:])).alias("members")).select("members")

    least = settings.percent / 100

    def run(batches):
        for batch in pieces(batches, 16):
            out: list[tuple[int, int]] = []
            for members in batch.column("members").to_pylist():
                query = np.array([m["query"] for m in members])
                nodes, parts = (np.array([m[c] for m in members], np.int64) for c in ("node", "component"))
                light = np.frombuffer(b"".join(m["light"] for m in members), np.uint8).reshape(len(members), settings.places)
                sets = [np.frombuffer(m["sketch"], np.uint32) for m in members]
                for k in np.flatnonzero(query):
                    hit = ~query & (parts != parts[k])
                    hit[hit] = agreeing(light[hit], light[k]) >= settings.estimate
                    best: dict[int, tuple[float, int]] = {}
                    for other in np.flatnonzero(hit):
                        alike, whole = sketched(sets[k], sets[other], settings.sketch)
                        if not whole and alike >= least - 0.08:  # six standard errors
                            out.append((nodes[other], nodes[k]))
                        elif whole and alike >= least - 0.01:
                            best[parts[other]] = max(best.get(parts[other], (0.0, 0)), (alike, nodes[other]))
                    out += [(other, nodes[k]) for _, other in best.values()]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def labelled(docs: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, node, n_shingles, smallest, the node that stands for its group, and component_id. The texts' whole sets are compared."""
    rows = stage_table(signed(docs, settings), "signatures")
    # a table of its own: joins with it are not bound to its partitioning, in which all copies of a text stand together
    firsts = stage_table(rows.filter("name IS NOT NULL").groupBy("name").agg(F.min("node").alias("node"), F.min("doc_id").alias("least")), "firsts")
    classes = stage_table(rows.join(firsts.select("name", "node"), ["name", "node"]).dropDuplicates(["name", "node"]).select("node", "name", "bands", "light"), "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    # members of a class under one doc_id with several texts: the bucket counts the id once
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).filter("first < last")
    buckets = stage_table(keys.join(shared.drop("last"), "key"), "buckets")
    texts = docs.select(node().alias("node"), "text")
    # of the smallest members that a node meets, first the one that it meets most often; the others where that leaves them apart
    met = stage_table(buckets.filter("node <> first").groupBy("node", "first").count(), "met")
    chosen = met.groupBy("node").agg(F.max_by("first", F.struct(F.col("count"), -F.col("first"))).alias("chosen"))
    links = stage_table(confirmed(likely(chosen.selectExpr("chosen a", "node b"), classes, settings), texts, settings), "links")
    labels = stage_table(components(links), "labels")
    others = met.join(chosen, "node").filter("first <> chosen").join(labels, "node", "left").withColumnRenamed("component", "own")
    others = others.join(labels.withColumnRenamed("node", "first"), "first", "left").filter("coalesce(own, node) <> coalesce(component, first)")
    second = confirmed(likely(others.selectExpr("first a", "node b"), classes, settings), texts, settings)
    links = stage_table(links.unionByName(second), "links")
    labels = stage_table(components(links), "labels")
    more = confirmed(across(buckets, labels, classes, texts, settings), texts, settings)
    labels = components(links.unionByName(stage_table(more, "more")))
    return reported(rows, firsts, labels)


def reported(rows: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    """Of rows (doc_id, node, n_shingles, name), the first node and smallest id of each name, and components: rows of doc_id, node, n_shingles, smallest (the node that stands for its group), component_id."""
    groups = firsts.join(labels, "node", "left").select("name", "least", F.coalesce("component", "node").alias("component"))
    lows = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage_table(groups.join(lows, "component").select("name", "component_id", F.coalesce("component_id", "component").alias("smallest")), "named")
    found = rows.select("doc_id", "n_shingles", "name", "node").join(named, "name", "left")
    return found.select("doc_id", "node", "n_shingles", F.coalesce("smallest", "node").alias("smallest"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def grouped(docs: DataFrame, settings: NearDuplicates = NearDuplicates()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return labelled(docs, settings).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("node") == F.col("smallest"))).alias("kept"))


def representatives(docs: DataFrame, settings: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of docs with one document of each group: the one of the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays. Rows without words are in no group, and all stay.
    """
    kept = labelled(docs, settings).filter("node = smallest").groupBy("node").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("most"))
    own = kept.select("node", ((F.col("rows") > 1) & (F.col("most") > 0)).alias("repeated"))
    met = packed(docs, node=node(), mark=F.xxhash64("text")).join(own, "node")
    copy = F.row_number().over(W.partitionBy("node", "mark").orderBy(F.lit(1)))
    return met.withColumn("copy", copy).filter("NOT repeated OR copy = 1").select("row.*")


def op2_super_minhash(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), NearDuplicates(words=4))
