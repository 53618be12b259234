"""op13 against plain counting, with thresholds small enough for small tables."""

import random
import re
from collections import Counter

import pytest

from wavelath.llm import collocations
from wavelath.llm.collocations import Collocations

from .conftest import table_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, settings):
    """rows: (lang, text)."""
    counts, sums = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sums[lang] += len(words)
            for size in range(1, settings.max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    held = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= settings.least}
    dropped = set()
    for (lang, words), a in held.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                if 100 * a >= settings.percent * held[inner]:
                    dropped.add(inner)
    out = {}
    for (lang, words), a in held.items():
        if (lang, words) in dropped:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * sums[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        ((lang, rank, phrase.decode(), -a, l, r, sums[lang], -score) for lang, own in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[: settings.best], 1)), key=repr
    )


@pytest.fixture(scope="module")
def with_lang(spark):
    return lambda rows: spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("settings", [Collocations(least=5, best=200), Collocations(least=8, max_words=3, percent=60, best=10_000), Collocations(least=4, best=150, shard_bytes=2000, part_rows=100, map_bits=20)])
def test_table_against_plain_counting(documents, settings):
    own = [(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()]
    got = table_of(collocations.collocations(documents, settings), *COLUMNS)
    assert got == plain(own, settings) and len(got) > 100


def test_signs_overlaps_and_forms(with_lang):
    rng = random.Random(4)
    parts = ["a b a b a", "New York", "new\tyork city", "naïve É É", "don't stop", "x.y", "ba", "b a", "ÀB c", "  nb sp", "q\x1cq r"]
    rows = [(rng.choice(["en", None, "und", ""]), rng.choice(["", " ", "\n"]).join(rng.choice(parts) + rng.choice([" ", ", ", ".", "\r\n", "\x0b", ""]) for _ in range(rng.randrange(12)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", "  \n.")]
    settings = Collocations(least=3)
    got = table_of(collocations.collocations(with_lang(rows), settings), *COLUMNS)
    assert got == plain(rows, settings) and len(got) > 30


def test_one_text_and_hot_phrase(with_lang):
    rows = [("en", "go on " * 20_000)] + [("en", "as a matter of fact")] * 700
    settings = Collocations(part_rows=1)
    assert table_of(collocations.collocations(with_lang(rows), settings), *COLUMNS) == plain(rows, settings)


def test_stretches_are_no_more_rows_than_phrases(spark):
    """Long stretches of frequent pairs, all different: their parts are as many as the phrases that they hold, and count each occurrence once."""
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice("abcd") for _ in range(40)), rng.randint(1, 3)) for _ in range(2000)]
    stretches = spark.createDataFrame(rows, "lang string, stretch string, n long").repartition(2)
    longer = collocations.bitmap(collocations.phrase_cells(stretches, 24, range(3, 6), 100), 24, 24)
    parts = [(r["stretch"], r["n"]) for r in collocations.parts_of(stretches, *longer, Collocations()).collect()]
    counts, found = Counter(), Counter()
    for into, own in ((counts, [r[1:] for r in rows]), (found, parts)):
        for text, n in own:
            words = text.split(" ")
            for size in range(2, 6):
                for i in range(len(words) - size + 1):
                    into[" ".join(words[i : i + size])] += n
    assert {p: n for p, n in counts.items() if n >= 100} == {p: n for p, n in found.items() if n >= 100}
    assert len(parts) <= len(counts) < len(rows)


def test_nothing_frequent(odd, with_lang):
    assert collocations.collocations(odd).filter("lang <> 'en'").collect() == []
    assert collocations.collocations(odd.limit(0)).collect() == []
    assert collocations.collocations(with_lang([("en", "a b"), ("en", "c")])).collect() == []
    clash = with_lang([("en", "a b")] * 100).selectExpr("doc_id", "text", "lang", "source phrase", "n_chars n", "doc_id word")
    assert table_of(collocations.collocations(clash), "phrase", "a", "n") == [("a b", 100, 200)]


def test_scores_behind_64_bits():
    """The sum of products is exact as far as decimals of 38 digits go: a, n and the parts up to 10^15 each."""
    assert 1000 * 10**15 * 10**15 < 10**38
