"""Personal data: fixed patterns, and identifiers learned from the contexts of those.

Everything here is DataFrame functions. The base patterns give seed entities.
Every token that looks like an identifier is a candidate, and so are neighbouring
groups of digits, unless a seed overlaps it. The last two words before a seed or a
candidate, on its line, are its lexical pattern; they are whole words, however long,
and may belong to what stands before. Patterns and the values found after them form
a graph. A value that is a seed has score 1; a pattern's confidence is the share of score
among its values, given enough seeds; a value's score is the chance that one of
its patterns is right. After a few rounds, values of high score after patterns of
high confidence are reported as learned.

Positions come from splitting a text at a pattern's matches: lengths of the
pieces and of the matches add up to starts and ends, in code points.

The patterns are written so that a search is linear in the text: a match may
begin only at the start of a run or where the last match ended, which is where
the leftmost match begins anyway, and runs are matched possessively where
nothing after them could use what they would give back.

Nulls count as empty texts: no spans, and the digest of the empty string. Rows
are told apart by doc_id and text; repeated rows have the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 16 digits are dropped anyway.
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = "[A-Za-z0-9@._%+()-]"
#: Digits with signs among them, in brackets perhaps; and several such groups with single blanks between them.
GROUP = r"[(+]*+[0-9](?:[().+-]*+[0-9]++)*+\)?+"
GROUPS = rf"{GROUP}(?:\x20{GROUP}(?![A-Za-z@_%]))++"
CANDIDATE = rf"(?<!{TOKEN})(?:{GROUPS}|(?=[A-Za-z._%+()-]*+[0-9@]){TOKEN}{{6,}}+)"
#: The last two words of a text, or the last one, on its last line, with the blanks behind them.
LAST_WORDS = r"(?<!\S)(?:\S++[ \t]++(?=\S))?+\S++[ \t]*+\z"
#: Matches of a text that are folded at once.
CHUNK = 256
SPAN = "struct<start:int,end:int,value:string,pattern:string>"


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: Seeds that a pattern needs.
    seeds: int = 3
    #: Least confidence of a pattern, and least score of a value, to report it.
    confidence: float = 0.6
    score: float = 0.6


def last_words(text: Column) -> Column:
    return F.regexp_extract(text, LAST_WORDS, 0)


def spans(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, and the last words before each as its pattern.

    The fold hands on the last words of all that it has passed, so that no context is cut by an earlier match. It goes by
    stretches of CHUNK matches: what it has found is copied once in a stretch, not at every match.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        before = last_words(F.concat(done["tail"], x["piece"]))
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.trim(F.lower(before)).alias("pattern"))
        return F.struct(
            F.coalesce(end, done["at"]).alias("at"), F.when(end.isNull(), "").otherwise(last_words(F.concat(before, x["hit"]))).alias("tail"),
            F.when(end.isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(found))).alias("out"),
        )

    nothing = F.array().cast(f"array<{SPAN}>")

    def stretch(done: Column, part: Column) -> Column:
        begin = F.struct(done["at"].alias("at"), done["tail"].alias("tail"), nothing.alias("out"))
        return F.aggregate(part, begin, step, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(done["parts"], F.array(x["out"])).alias("parts")))

    # an array of one, so that the matches are looked for once and not for each stretch
    parts = F.element_at(F.transform(F.array(both), lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / CHUNK).cast("int")), lambda k: F.slice(b, k * CHUNK + 1, F.lit(CHUNK)))), 1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    return F.aggregate(parts, start, stretch, lambda done: F.flatten(done["parts"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def step(total: Column, k: Column) -> Column:
        digit = F.substring(number, F.length(number) - k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether every part between dots is at most 255."""
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column, kind: str) -> Column:
    """A kind's spans; texts that cannot hold one are not searched."""
    pattern, needs, holds = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda x: small_parts(x["value"])),
        "card": (CARD, text.rlike("[0-9]"), lambda x: F.length(digits(x["value"])).between(16, 19) & luhn(digits(x["value"]))),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda x: F.length(digits(x["value"])).between(8, 15)),
    }[kind]
    found = spans(text, pattern)
    return F.when(needs, F.filter(found, holds) if holds else found).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(found: Column, kind: Column | str) -> Column:
    """Spans as kind:start:end."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda x: F.concat_ws(":", name, x["start"], x["end"]))


def surveyed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark (a digest of the text), the spans of each kind, and the candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast(f"array<{SPAN}>")
    possible = F.when(text.rlike("[0-9@]"), F.filter(spans(text, CANDIDATE), lambda x: F.length(x["value"]) >= 6)).otherwise(nothing)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), *[base_spans(text, k).alias(k) for k in KINDS], possible.alias("candidates"))


def learned(rows: DataFrame, settings: Bootstrap) -> DataFrame:
    """doc_id, mark, start, end of the candidates that patterns vouch for."""
    every = F.concat(*[F.transform(k, lambda x, k=k: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["pattern"].alias("pattern"), F.lit(k).alias("kind"))) for k in KINDS])
    new = F.transform("candidates", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["pattern"].alias("pattern"), F.lit(None).cast("string").alias("kind")))
    found = rows.select("doc_id", "mark", F.explode(F.concat(every, new)).alias("i")).select("doc_id", "mark", "i.*")
    # a candidate that a seed overlaps is none: of the seeds that begin before it the one that ends last, of those behind it the first one
    seed, text = F.col("kind").isNotNull(), W.partitionBy("doc_id", "mark")
    ends = F.max(F.when(seed, F.col("end"))).over(text.orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow))
    # from the other end, so that a frame grows and is not begun anew for each row
    begins = F.min(F.when(seed, F.col("start"))).over(text.orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow))
    free = found.withColumn("before", ends).withColumn("behind", begins).filter("kind IS NOT NULL OR (coalesce(before, -1) <= start AND coalesce(behind, end) >= end)")
    instances = stage_table(free.drop("before", "behind").filter("pattern <> ''"), "instances")
    edges = stage_table(instances.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    scored = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
    seeds = edges.filter("kind IS NOT NULL").select("value").distinct().withColumn("seed", F.lit(True))
    trusted = None
    for _ in range(settings.rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("kind").isNotNull()).alias("n_seeds")).filter(f"n_seeds >= {settings.seeds}")
        trusted = stage_table(patterns.select("pattern", "confidence"), "patterns")
        values = edges.join(trusted, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("vouched"))
        known = edges.join(values, "value", "left").join(seeds, "value", "left")
        scored = stage_table(known.select("pattern", "value", "kind", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("vouched", F.lit(0.0))).alias("score")), "scored")
    good = scored.filter(f"kind IS NULL AND score >= {settings.score}").join(trusted.filter(f"confidence >= {settings.confidence}"), "pattern").select("pattern", "value")
    return instances.filter("kind IS NULL").join(good, ["pattern", "value"]).select("doc_id", "mark", "start", "end")


def scan(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, a count for each kind, the base digest, n_learned, and all spans by kind and start."""
    rows = stage_table(surveyed(docs), "surveyed")
    more = learned(rows, settings).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("learned"))
    both = rows.alias("x").join(more.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.mark") == F.col("y.mark")), "left")
    extra = F.coalesce("learned", F.array().cast("array<struct<start:int,end:int>>"))
    base = F.concat(*[joined(F.col(k), k) for k in KINDS])
    return both.select(
        "x.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.size(extra).cast("long").alias("n_learned"), F.array_join(F.concat(base, joined(extra, "learned")), ",").alias("spans"),
    )


def op8_bootstrapped_contexts(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
