"""Periodic runs of words, by partition refinement.

A run is a longest stretch of words in which words a period apart are equal, over
several periods. Positions of a text are kept in classes: at level l two positions
share a class where the l words from them on are equal. A level refines the one
before: a position's new class follows from its old one and that of the next
position. Members of a class that follow one another at a distance of l are a
square of period l, and squares at neighbouring positions are one run.

The first levels, in which most positions of plain prose become alone in their
class, sort what is left of all texts of a batch at once. The few texts that have
more go on by the smaller half: when a class splits, only its smaller parts split
others at the next level, so that a position is moved O(log n) times and a text of
n words costs O(n log n), however it repeats. Classes are linked lists in order of
position; a distance that a move brings about is noted under the level at which it
would be a square, and looked at there.

A text is a row, and a row is a task's work alone: nothing is shuffled.

Words are what stands between ASCII blanks. Null texts, empty ones and ones
without words have no runs and collapse to an empty text. A null doc_id stays
null. Repeated rows give repeated rows; other columns are left out, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class WordRuns:
    #: A run has so many words, and so many periods, at least.
    min_words: int = 6
    min_periods: int = 4
    #: Levels at which all texts of a batch are refined together.
    levels: int = 8


def by_class(classes: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """at in order of class (and of a second one), then of position; and where a new group begins."""
    order = np.argsort(classes, kind="stable") if second is None else np.lexsort((second, classes))
    at, classes = at[order], classes[order]
    new = np.ones(len(at), bool)
    new[1:] = classes[1:] != classes[:-1]
    if second is not None:
        second = second[order]
        new[1:] |= second[1:] != second[:-1]
    return at, new


def smaller_halves(classes: list[int], members: dict[int, list[int]], small: list[tuple[int, list[int]]], level: int, last: int) -> list[tuple[int, int]]:
    """Squares (period, position) of one text at the levels behind level, up to last.

    classes: of each position and of the end. members: of the classes of several, in order. small: the classes that split others next.
    """
    count = len(classes)
    after, before = [-1] * count, [-1] * count
    size, head = {}, {}
    due: dict[int, list[int]] = {}
    for c, group in members.items():
        size[c], head[c] = len(group), group[0]
        for x, y in zip(group, group[1:]):
            after[x], before[y] = y, x
            if level < y - x <= last:
                due.setdefault(y - x, []).append(x)
    fresh = 2 * count  # a class that comes into being has a number that none had
    found = []
    while small and level < last:
        level += 1
        moves: dict[int, dict[int, list[int]]] = {}
        for c, group in small:
            for j in group:
                if j and size.get(old := classes[j - 1], 1) > 1:
                    moves.setdefault(old, {}).setdefault(c, []).append(j - 1)
        small = []
        for old, parts in moves.items():
            rest = size[old] - sum(map(len, parts.values()))
            if not rest and len(parts) == 1:
                continue
            largest = max(parts.values(), key=len)
            for part in parts.values():
                touched = set()
                for x in part:
                    p, s = before[x], after[x]
                    if p < 0:
                        head[old] = s
                    else:
                        after[p] = s
                        touched.add(p)
                    if s >= 0:
                        before[s] = p
                touched.difference_update(part)
                fresh += 1
                size[fresh], head[fresh] = len(part), part[0]
                for x in part:
                    classes[x] = fresh
                for x, y in zip(part, part[1:]):
                    after[x], before[y] = y, x
                before[part[0]] = after[part[-1]] = -1
                for x in chain(touched, part):
                    if level <= (far := after[x] - x) <= last:
                        due.setdefault(far, []).append(x)
                if part is not largest or len(part) < rest:
                    small.append((fresh, part))
            size[old] = rest
            if rest and len(largest) >= rest:
                left, x = [], head[old]
                while x >= 0:
                    left.append(x)
                    x = after[x]
                small.append((old, left))
        found += [(level, x) for x in due.pop(level, ()) if after[x] == x + level]
    return found


def repetitions(texts: list[np.ndarray], settings: WordRuns = WordRuns()) -> np.ndarray:
    """The runs of texts given as numbers of words: rows (text, start, length, period), in this order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # behind each text an end that equals nothing
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = sizes // settings.min_periods
    at = np.arange(len(owner)) + owner
    words = np.concatenate([np.zeros(0, np.int64), *texts])
    classes = np.arange(begins[-1])
    held = last[owner] > 0
    at, owner, words = at[held], owner[held], words[held]
    texts_of = np.repeat(np.arange(len(texts)), sizes + 1)
    squares = [np.zeros((0, 2), np.int64)]
    level, key, second = 1, owner * (int(words.max(initial=0)) + 1) + words, None
    while len(at):
        at, new = by_class(key, at, second)
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        counts = np.diff(np.append(firsts, len(at)))
        old = classes[at]
        classes[at] = at[firsts][group]  # a class is called after its first position
        hit = at[np.flatnonzero(~new[1:] & (np.diff(at) == level))] if len(at) > 1 else at[:0]
        squares.append(np.stack([np.full(len(hit), level), hit], axis=1))
        if level == settings.levels:
            break
        stays = counts[group] > 1
        at = at[stays]
        level += 1
        at = at[last[texts_of[at]] >= level]
        at.sort()
        key, second = classes[at], classes[at + 1]
    if len(at):
        # parts of a class of the level before: all but the largest split others
        parent = old[firsts]
        order = np.lexsort((-counts, parent))
        largest = np.ones(len(order), bool)
        largest[1:] = parent[order][1:] != parent[order][:-1]
        is_small = np.ones(len(firsts), bool)
        is_small[order[largest]] = level == 1  # nothing has been split by the first classes
        doc_of = texts_of[at]
        more = (counts[group] > 1) & (last[doc_of] > level)
        for d in np.unique(doc_of[more]).tolist():
            base, size = int(begins[d]), int(sizes[d])
            members: dict[int, list[int]] = {}
            small: list[tuple[int, list[int]]] = [(size, [size])] if level == 1 else []
            mine = np.unique(group[doc_of == d]).tolist()
            for g in mine:
                part = (at[firsts[g] : firsts[g] + counts[g]] - base).tolist()
                if len(part) > 1:
                    members[part[0]] = part
                if is_small[g]:
                    small.append((part[0], part))
            local = (classes[base : base + size + 1] - base).tolist()
            found = smaller_halves(local, members, small, level, int(last[d]))
            if found:
                squares.append(np.array(found, np.int64) + np.array([0, base]))
    met = np.concatenate(squares)
    met = met[np.lexsort((met[:, 1], met[:, 0]))]
    period, place = met[:, 0], met[:, 1]
    new = np.ones(len(met), bool)
    new[1:] = (np.diff(period) != 0) | (np.diff(place) > 1)
    firsts = np.flatnonzero(new)
    ends = np.append(firsts[1:], len(met)) - 1
    if not len(met):
        return np.zeros((0, 4), np.int64)
    period, start = period[firsts], place[firsts]
    length = place[ends] - start + 2 * period
    doc = texts_of[start]
    runs = np.stack([doc, start - begins[doc], length, period], axis=1)
    runs = runs[length >= np.maximum(settings.min_words, settings.min_periods * period)]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that stand in a run behind its first period. runs: rows (start, length, period)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:size]) == 0


def collapsed(docs: DataFrame, settings: WordRuns = WordRuns()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, runs (start, length, period; by start, then period), and text, the words that no run repeats, joined by blanks."""

    def run(batches):
        for batch in pieces(batches, 256):
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            names: dict[bytes, int] = {}
            texts = [np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int64, len(ws)) for ws in words]
            found = repetitions(texts, settings)
            edges = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
            runs, rest = [], []
            for k, ws in enumerate(words):
                own = found[edges[k] : edges[k + 1], 1:]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                rest.append(b" ".join([ws[i] for i in np.flatnonzero(kept_words(len(ws), own))] if len(own) else ws).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, RUN_TYPE), pa.array(rest, pa.string())], ["doc_id", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, text string")


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a loop in every tenth text, by the digest of its doc_id: from a place on the words of one stretch come round again and again."""
    words: Column = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    digest = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(digest % 10 == 0, words).alias("w"), F.floor(digest / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("if(n > 0, g % n, null)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(w, int(if(i < a, i, a + (i - a) % p)) + 1)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark, sf_dir: str) -> DataFrame:
    found = collapsed(looped(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "text")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
