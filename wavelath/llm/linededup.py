"""Line dedup by deletion neighbourhoods: of equal and nearly equal lines the earliest stays.

Everything here is DataFrame functions. A line is its words between blanks.
Equal lines are grouped by a digest. Two lines are nearly equal when one word
inserted, deleted or replaced makes them equal. Every line emits all variants
with one word deleted, and itself at every gap, as hashed keys with the place of
the deletion; lines whose keys meet differ by one edit at that place, which is
then verified on the words. All lines of a key are within the bound of its
earliest line, so a join with that one line decides for all: no bucket is
gathered, and no pair within a bucket is formed.

Most lines have no near copy, and a line emits twice as many keys as it has
words. So halves find suspects first: of two lines within one edit, either the
first halves are equal or the last ones. Lines that share neither half with
another line cannot be near copies and emit nothing more. Lines of even length
emit halves of two lengths, so that they meet lines of a word more or less.

Sums of masked word hashes stand for runs of words; a place in the line, counted
from its beginning or from its end, is part of each hash.

Lines of fewer than min_words words stay in their text, as headings and signs
repeat everywhere; every other line takes part with its neighbourhood. A row is a
copy as a whole when each of its lines of that length is dropped and its shorter
ones stand together in one earlier row: an earlier row has the same set of short
lines, or all of them first stood in the same row. Short lines that stand in
several earlier rows, one here and one there, leave it in place. The earliest line
is the one of the smallest doc_id, then of the smallest place in the text; rows
without a doc_id come last. Rows that share doc_id and text are treated alike.
Null texts stay null, empty ones empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, stage_table, table

LAST = (1 << 63) - 1
#: Hashes of 40 bits: sums of millions of them stay in a long.
MASK = (1 << 40) - 1
PLACE = ["doc", "mark", "line_no"]
HALVES = ["a0", "b0", "a1", "b1"]


@dataclass(frozen=True)
class LineDedup:
    min_words: int = 5
    #: Shortest line that has near copies.
    fuzzy_words: int = 5


def row_key() -> dict[str, Column]:
    """What a row is known by: doc (its doc_id, the highest number for none) and mark (a digest of its text)."""
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "mark": F.xxhash64(F.coalesce("text", F.lit("")))}


def blanks(text: Column) -> Column:
    """text with a plain blank for every other blank but the line break, null as empty."""
    out = F.coalesce(text, F.lit(""))
    for sign in "\t\x0b\f\r":
        out = F.replace(out, F.lit(sign), F.lit(" "))
    return out


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def short_hash(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(MASK))


def lines(docs: DataFrame, settings: LineDedup) -> DataFrame:
    """A row for each line with words: its place, two digests, whether it has fewer than min_words, and the keys of its halves if it can have near copies."""
    rows = docs.select("doc", "mark", F.posexplode(F.split(blanks(F.col("text")), "\n", -1)).alias("line_no", "line"))
    rows = rows.select(*PLACE, words_of(F.col("line")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    short = F.col("n") < settings.min_words
    long = ~short & (F.col("n") >= settings.fuzzy_words)
    half = F.floor(F.col("n") / 2).cast("int")
    even = long & (F.col("n") % 2 == 0)
    front = lambda p: F.xxhash64(F.lit(0), p, F.slice("words", F.lit(1), p))
    back = lambda p: F.xxhash64(F.lit(1), p, F.slice("words", F.col("n") - p + 1, p))
    keys = [F.when(long, front(half)), F.when(long, back(half)), F.when(even, front(half - 1)), F.when(even, back(half - 1))]
    return rows.select(*PLACE, F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), short.alias("short"), *[k.alias(name) for k, name in zip(keys, HALVES, strict=True)])


def firsts(rows: DataFrame) -> DataFrame:
    """Distinct lines: the earliest place, how many there are, the halves."""
    earliest = F.min(F.struct(*PLACE)).alias("first")
    return rows.groupBy("h1", "h2").agg(earliest, F.count("*").alias("n"), *[F.first(c).alias(c) for c in HALVES]).select("h1", "h2", "first.*", "n", *HALVES)


def suspects(distinct: DataFrame) -> DataFrame:
    """Places of the lines that share a half with another line."""
    keys = distinct.filter("a0 IS NOT NULL").select(*PLACE, F.explode(F.array(*HALVES)).alias("key")).filter("key IS NOT NULL")
    shared = stage_table(keys.groupBy("key").count().filter("count > 1").select("key"), "shared")
    return keys.join(shared, "key", "left_semi").select(*PLACE).distinct()


def neighbourhood(words: DataFrame) -> DataFrame:
    """Of suspect lines (place, words): key and at for each variant with one word deleted, and for the line itself at each gap."""
    n = F.size("words")
    each = words.select(*PLACE, n.alias("n"), F.posexplode("words").alias("at", "word"))
    front, back = short_hash(F.col("word"), F.col("at")), short_hash(F.col("word"), F.col("n") - F.col("at"), F.lit(1))
    before = W.partitionBy(*PLACE).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*PLACE).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*PLACE)
    zero = F.lit(0).cast("long")
    sums = each.withColumn("front", front).withColumn("back", back)
    sums = sums.select(
        *PLACE, "n", "at", "front", "back", F.coalesce(F.sum("front").over(before), zero).alias("left"), F.sum("back").over(after).alias("passed"), F.sum("back").over(whole).alias("all")
    )
    rest = F.col("all") - F.col("passed")
    gap = F.struct("at", "left", (rest + F.col("back")).alias("rest"))
    deleted = F.struct("at", "left", rest.alias("rest"))
    last = F.when(F.col("at") == F.col("n") - 1, F.struct((F.col("at") + 1).alias("at"), (F.col("left") + F.col("front")).alias("left"), zero.alias("rest")))
    keys = sums.select(*PLACE, F.explode(F.array(gap, deleted, last)).alias("k")).filter("k IS NOT NULL")
    return keys.select(*PLACE, F.xxhash64("k.at", "k.left", "k.rest").alias("key"), F.col("k.at").alias("at"))


def one_edit(x: Column, y: Column, at: Column) -> Column:
    """Whether one word inserted, deleted or replaced at a place makes x and y equal."""
    skip = lambda w, k: F.slice(w, at + 1 + k, F.greatest(F.size(w) - at - k, F.lit(0)))
    more = F.size(x) - F.size(y)
    same_end = F.when(more == 0, skip(x, 1) == skip(y, 1)).when(more == 1, skip(x, 1) == skip(y, 0)).when(more == -1, skip(x, 0) == skip(y, 1)).otherwise(False)
    return (F.slice(x, F.lit(1), at) == F.slice(y, F.lit(1), at)) & same_end


def near_copies(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines that an earlier line is within one edit of."""
    by_row = suspects(distinct).groupBy("doc", "mark").agg(F.collect_set("line_no").alias("wanted"))
    texts = docs.select("doc", "mark", "text").join(by_row, ["doc", "mark"])
    every = texts.select("doc", "mark", F.posexplode(F.split(blanks(F.col("text")), "\n", -1)).alias("line_no", "line"), "wanted").filter(F.array_contains("wanted", F.col("line_no")))
    # repeated rows: under another name of the id they are combined before a shuffle of their own, so that the join above may be split
    turned = F.col("doc").bitwiseXOR(F.lit(1))
    single = every.select(turned.alias("doc"), "mark", "line_no", words_of(F.col("line")).alias("words")).dropDuplicates(PLACE)
    words = stage_table(single.withColumn("doc", turned), "suspects")
    keys = neighbourhood(words)
    # equal keys in one line (a word twice in a row) are one entry
    met = keys.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")).filter("first < last")
    met = stage_table(met.select("key", "first"), "met")
    pairs = keys.join(met, "key").filter(F.struct(*PLACE) > F.col("first")).groupBy(*PLACE, "first").agg(F.min("at").alias("at"))
    early = words.select(F.struct(*PLACE).alias("first"), F.col("words").alias("earlier"))
    both = pairs.join(words, PLACE).join(early, "first")
    return both.filter(one_edit(F.col("words"), F.col("earlier"), F.col("at"))).select(*PLACE)


def together(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """doc, mark: rows whose short lines stand together in an earlier row. copies: short lines that an earlier row has, each with the place that it first stood at."""
    sets = stage_table(rows.filter("short").select("doc", "mark", "h1", "h2").distinct().groupBy("doc", "mark").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x"), F.bit_xor("h2").alias("y")), "sets")
    alike = sets.groupBy("n", "x", "y").agg(F.min(F.struct("doc", "mark")).alias("row"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    same = sets.join(alike, ["n", "x", "y"]).filter(F.struct("doc", "mark") > F.col("row"))
    held = copies.select("doc", "mark", "h1", "h2", F.struct("first.doc", "first.mark").alias("row")).distinct().groupBy("doc", "mark").agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
    one = held.filter("low = high").join(sets, ["doc", "mark", "n"])
    return same.select("doc", "mark").unionByName(one.select("doc", "mark")).distinct()


def dropped(docs: DataFrame, settings: LineDedup = LineDedup()) -> DataFrame:
    """Per row with such lines: doc, mark, the places of those to drop in gone, and in copied the places of its short lines if these stand together in an earlier row. docs: doc, mark, text."""
    rows = stage_table(lines(docs, settings), "lines")  # read several times: cheaper than the texts
    distinct = stage_table(firsts(rows), "distinct")
    near = stage_table(near_copies(docs, distinct), "near")
    copies = rows.select(*PLACE, "h1", "h2", "short").join(distinct.filter("n > 1").select("h1", "h2", F.struct(*PLACE).alias("first")), ["h1", "h2"])
    equal = copies.filter(~F.col("short") & (F.struct(*PLACE) != F.col("first"))).select(*PLACE, "short")
    early = copies.filter(F.col("short") & (F.struct("doc", "mark") != F.struct("first.doc", "first.mark")))
    short = rows.filter("short").select(*PLACE, "short").join(together(rows, early), ["doc", "mark"])
    places = equal.unionByName(short.select(*PLACE, "short")).unionByName(near.withColumn("short", F.lit(False)))
    return stage_table(places.groupBy("doc", "mark").agg(F.collect_set(F.expr("if(short, null, line_no)")).alias("gone"), F.collect_set(F.expr("if(short, line_no, null)")).alias("copied")), "gone")


def marked(docs: DataFrame, settings: LineDedup = LineDedup()) -> DataFrame:
    """As clean, and whether a row is a copy as a whole in is_copy."""
    key = row_key()
    gone = dropped(docs.select(*[c.alias(name) for name, c in key.items()], "text"), settings)
    both = packed(docs, **key).join(gone, ["doc", "mark"], "left")
    split = F.split("row.text", "\n", -1)
    kept = F.filter(F.transform(split, lambda x, k: F.struct(x.alias("line"), k.alias("at"))), lambda x: ~F.array_contains("gone", x["at"]))
    n_gone = F.coalesce(F.size("gone"), F.lit(0))
    text = F.when(n_gone == 0, F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    own_words = F.size(F.filter(split, lambda x: x.rlike(r"\S"))) - n_gone - F.size("copied")
    counts = {"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_dropped": n_gone.cast("long"), "is_copy": F.coalesce(own_words == 0, F.lit(False))}
    own = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in counts]
    return both.select(*own, *[c.alias(name) for name, c in counts.items()])


def clean(docs: DataFrame, settings: LineDedup = LineDedup()) -> DataFrame:
    """The rows of docs, their texts without the dropped lines; n_lines and n_dropped are added, in place of columns of their names."""
    return marked(docs, settings).drop("is_copy")


def op7_deletion_neighbours(spark, sf_dir: str) -> DataFrame:
    found = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "is_copy", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
