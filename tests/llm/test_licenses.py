"""op5 against a plain alignment over whole documents, and licenses with words put in, left out and decoys around them."""

import random

import pytest

from wavelath.llm import licenses
from wavelath.llm.licenses import GAP, NOTICES, LicenseScan


def placed(*texts):
    """(name, coverage, matched words, words of the span) of the finds in each text."""
    library = {k: v for k, v in NOTICES.items()}
    templates = {n: (licenses.words_of(t.encode())[0].tolist(), len(licenses.winnowed(licenses.words_of(t.encode())[0], LicenseScan())[0])) for n, t in library.items()}
    out = []
    for text in texts:
        at, named = licenses.winnowed(licenses.words_of(text.encode())[0], LicenseScan())
        hits = [
            {"template": n, "at": int(a), "place": int(p)}
            for n, t in library.items()
            for a, h in zip(*licenses.winnowed(licenses.words_of(t.encode())[0], LicenseScan()), strict=True)
            for p, g in zip(at, named, strict=True)
            if g == h
        ]
        out.append([(n, c, m, text[a:b]) for n, c, a, b, m in licenses.finds(text, hits, templates, LicenseScan())])
    return out


def plain_alignment(template, found):
    """Matched words of the best local alignment, over all cells and all gaps."""
    best, score = (0, 0), {}
    get = lambda i, j: score.get((i, j), (0, 0))
    for i in range(len(template)):
        for j in range(len(found)):
            s, m = get(i - 1, j - 1)
            cell = (s + 2, m + 1) if template[i] == found[j] else (s - 1, m)
            for k in range(1, i + 1):
                cell = max(cell, (get(i - k, j)[0] - GAP, get(i - k, j)[1]))
            for k in range(1, j + 1):
                cell = max(cell, (get(i, j - k)[0] - GAP, get(i, j - k)[1]))
            if cell[0] > 0:
                score[i, j] = cell
                best = max(best, cell)
    return best[1]


@pytest.mark.parametrize("seed", range(12))
def test_alignment_against_a_plain_one(seed):
    rng = random.Random(seed)
    template = [rng.randrange(12) for _ in range(24)]
    found = list(template)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(found))
        found[k : k + rng.randrange(3)] = [100 + rng.randrange(50) for _ in range(rng.randrange(12))]
    found = [200 + k for k in range(10)] + found + [300 + k for k in range(10)]
    path = [(i, j) for i in range(24) for j in range(len(found)) if template[i : i + 3] == found[j : j + 3] and len(template[i : i + 3]) == 3]
    rising = []
    for i, j in path:
        if not rising or i > rising[-1][0] and j > rising[-1][1]:
            rising.append((i, j))
    assert rising
    assert licenses.align(template, found, rising, 40)[0] == plain_alignment(template, found)


@pytest.mark.parametrize("count", [1, 6, 9, 12, 40])
def test_words_put_in(count):
    words = NOTICES["MIT"].split()
    text = "head of a file " * 5 + " ".join([*words[:70], *[f"foreign{k}" for k in range(count)], *words[70:]]) + " tail of a file"
    [found] = placed(text)
    assert [(n, c) for n, c, _, _ in found] == [("MIT", 1.0)]
    assert found[0][3].startswith("Permission") and found[0][3].endswith("NONINFRINGEMENT")


@pytest.mark.parametrize("count", [9, 13])
def test_words_left_out(count):
    words = NOTICES["Apache-2.0 header"].split()
    [found] = placed(" ".join([*words[:30], *words[30 + count :]]))
    assert [n for n, _, _, _ in found] == ["Apache-2.0 header"] and 0.7 < found[0][1] < 1


def test_decoys_do_not_part_a_license():
    words = NOTICES["MIT"].split()
    decoys = [" ".join(words[k : k + 6]) for k in (0, 30, 60, 90, 120)]
    text = []
    for k in range(0, len(words), 25):
        text += [*words[k : k + 25], *decoys]
    [found] = placed(" ".join(text))
    assert [(n, c) for n, c, _, _ in found] == [("MIT", 1.0)]


def test_two_copies_are_two_finds():
    text = NOTICES["ISC"] + " and once more " + NOTICES["ISC"] + " " + "filler words " * 200 + NOTICES["ISC"]
    [found] = placed(text)
    assert [(n, c) for n, c, _, _ in found] == [("ISC", 1.0)] * 3


def test_halves_far_apart_are_no_license():
    words = NOTICES["MIT"].split()
    [found] = placed(" ".join(words[:70]) + " filler" * 2000 + " " + " ".join(words[70:]))
    assert found == []


@pytest.mark.parametrize("count", [400, 2000])
def test_parts_any_distance_apart(count):
    """Without a bound on foreign words a license is one find however far its parts stand from each other."""
    words = NOTICES["MIT"].split()
    text = " ".join([*words[:70], *[f"foreign{k}" for k in range(count)], *words[70:]])
    data = licenses.words_of(text.encode())[0]
    template = licenses.words_of(NOTICES["MIT"].encode())[0]
    prints = dict(zip(licenses.winnowed(template, licenses.LicenseScan())[1].tolist(), licenses.winnowed(template, licenses.LicenseScan())[0].tolist()))
    at, named = licenses.winnowed(data, licenses.LicenseScan())
    hits = [{"template": "MIT", "at": prints[h], "place": int(p)} for p, h in zip(at.tolist(), named.tolist()) if h in prints]
    templates = {"MIT": (template.tolist(), len(prints))}
    assert licenses.finds(text, hits, templates, licenses.LicenseScan()) == []
    [found] = licenses.finds(text, hits, templates, licenses.LicenseScan(foreign=None))
    assert found[:2] == ("MIT", 1.0) and text[found[2] : found[3]] == text.rstrip(".")


def test_long_words_differ_in_every_place():
    a, b = (licenses.words_of(w.encode())[0][0] for w in ("a" + "x" * 63 + "b", "b" + "x" * 63 + "a"))
    assert a != b
    assert licenses.words_of(b"Word word")[0].tolist() == [licenses.words_of(b"word")[0][0]] * 2


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_every_notice_is_told_from_the_others(name):
    [found] = placed(f"some words before. {NOTICES[name]} and some behind")
    assert (name, 1.0) in [(n, c) for n, c, _, _ in found]


def test_many_repeated_phrases(make):
    text = "Licensed under the Apache " * 3000 + NOTICES["Apache-2.0 header"]
    found = [(r["license"], r["coverage"]) for r in licenses.scan(make((1, text))).collect()]
    assert ("Apache-2.0 header", 1.0) in found
