"""op3 against a plain comparison of every window of every document with every window of every item."""

import random

import pytest

from wavelath.llm import decontam
from wavelath.llm.decontam import DOUBTFUL, ENDS, NAME, NUM, NUMBER, NUMBER_WORDS, STRIP, UNIT, UNITS


def plain_words(text):
    """(type, low, whether a name if it is read so) of each word."""
    out = []
    for line in (text or "").split("\n"):
        fresh = True
        for raw in line.split():
            bare = raw.strip(STRIP)
            low = bare.lower()
            kind = NUM if bare and NUMBER.match(bare) or low in NUMBER_WORDS else UNIT if low in UNITS and low not in DOUBTFUL else 0
            capital = not kind and bare[:1].isupper() and (len(bare) == 1 or not bare.isupper())
            begins, fresh = fresh, raw[-1] in ENDS
            if not bare:
                continue
            if capital and not begins:
                kind = NAME
            if low in DOUBTFUL and not begins and out and out[-1][0] == NUM:
                kind = UNIT
            out.append((kind, low, capital and begins))
    return out


def read(words, names):
    """(type, low, doubtful) as one reads the words."""
    return [(NAME if doubt and names and not k else k, low, doubt) for k, low, doubt in words]


def literals(words):
    return sum(k == 0 for k, *_ in words)


def least(size):
    return 4 if size >= 8 else min(4, size, max(3, (size + 1) // 2))


def item_windows(words, names):
    """(place, size, whether word for word)."""
    size = min(len(words), 8)
    for at in range(len(words) - size + 1 if size else 0):
        if literals(words[at : at + size]) >= least(size):
            yield at, size, False
            continue
        if size >= 3 and not names:
            yield at, size, True
        if size == 8:
            for more in range(9, 17):
                if at + more <= len(words) and literals(words[at : at + more]) >= 4:
                    yield at, more, False
                    break


def symbols(words):
    return [k or low for k, low, _ in words]


def plain_matches(docs, items):
    """{(doc, item): (coverage, changed)}."""
    out = {}
    for d, text in docs:
        for i, item in items:
            met = {}
            for item_names in (False, True):
                words = read(plain_words(item), item_names)
                for at, size, exact in item_windows(words, item_names):
                    window = words[at : at + size]
                    item_doubt = any(x[2] for x in window)
                    for doc_names in (False, True):
                        own = read(plain_words(text), doc_names)
                        for place in range(len(own) - size + 1):
                            other = own[place : place + size]
                            doubt = any(x[2] for x in other)
                            if exact:
                                same = not doc_names and literals(other) < least(size) and [x[1] for x in other] == [x[1] for x in window]
                            else:
                                same = literals(other) >= least(size) and symbols(other) == symbols(window)
                            if not same or item_names and not item_doubt or doc_names and not doubt:
                                continue
                            named = item_names or doc_names
                            for reading in ([1] if named else [0] if item_doubt or doubt else [0, 1]):
                                spans, slots, places = met.setdefault(place - at, {}).setdefault(reading, (set(), set(), set()))
                                spans.update(range(at, at + size))
                                places.add(place)
                                slots.update((k, at + j, window[j][1], other[j][1]) for j, (k, *_) in enumerate(window) if k == NUM or k and not exact)
            covered, changed = set(), 0
            for readings in met.values():
                good = []
                for reading, (spans, slots, places) in readings.items():
                    pairs = {(k, old, new) for k, _, old, new in slots}
                    if len({(k, old) for k, old, _ in pairs}) == len(pairs) == len({(k, new) for k, _, new in pairs}):
                        good.append((len(places), -reading, spans, sum(old != new for _, _, old, new in slots)))
                if good:
                    _, _, spans, more = max(good, key=lambda g: g[:2])
                    covered |= spans
                    changed += more
            words = plain_words(item)
            if words and len(covered) >= 0.5 * len(words):
                out[d, i] = (round(len(covered) / len(words), 6), changed)
    return out


def one_of_each_class(items):
    """Items that differ in more than the values of their slots; the smallest id of each class."""
    seen = {}
    for i, item in sorted(items):
        words = read(plain_words(item), True)
        first = {}
        same = [first.setdefault((k, low), at) if k else at for at, (k, low, _) in enumerate(words)]
        exact = any(e for *_, e in item_windows(read(plain_words(item), False), False))
        seen.setdefault((tuple(symbols(words)), tuple(same), tuple(x[1] for x in words) if exact else None), (i, item))
    return list(seen.values())


VOCABULARY = ["train", "leaves", "station", "and", "covers", "the", "old", "road", "while", "waits", "in", "a", "m", "km", "hours", "7", "12", "3.5", "two", "Alice", "Berlin", "USA", "end.", "so,", "*", "5%", "The", "Then", "Alice."]


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_comparison(spark, make, seed):
    rng = random.Random(seed)
    items = one_of_each_class((k, " ".join(rng.choices(VOCABULARY, k=rng.choice([1, 2, 3, 5, 8, 9, 12, 20, 30])))) for k in range(40))
    swaps = {"7": "9", "12": "15", "Alice": "Carol", "Berlin": "Paris", "km": "miles", "two": "six"}
    docs = []
    for k in range(60):
        words = rng.choice(items)[1].split()
        if rng.random() < 0.6:  # values change, all alike or each for itself
            words = [swaps.get(w, w) if rng.random() < rng.choice([1, 0.7]) else w for w in words]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "other"
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + ["foreign"] * 3 + words[len(words) // 2 :]
        docs.append((k, " ".join(rng.choices(VOCABULARY, k=rng.randrange(6)) + words + rng.choices(VOCABULARY, k=rng.randrange(6)))))
    found = decontam.matches(make(*docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["coverage"], r["changed"]) for r in found.collect()} == plain_matches(docs, items)


def test_the_table_against_a_plain_comparison(spark, sf_dir, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(25).collect() if r["text"]]
    assert len(one_of_each_class(items)) == len(items)
    few = [r for r in rows if r[1] and len(r[1]) < 2500][:60]
    few += [(1000 + k, f"some words ahead {t} and behind") for k, t in items[::5]]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    found = decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["coverage"], r["changed"]) for r in found.collect()} == plain_matches(few, items)


PROBES = [
    (1, "Alice has 3 apples left", "Bob has 7 apples left"),
    (2, "Natalia sold 48 clips to her friends", "Maria sold 52 clips to her friends"),
    (3, "Alice buys 12 pens at the shop. Alice pays 3 dollars for each of them. Alice keeps 5 of them", "Carol buys 15 pens at the shop. Carol pays 2 dollars for each of them. Carol keeps 9 of them"),
]


def test_names_that_begin_sentences(spark, make):
    """Questions with other names and numbers are found wherever the name stands; one whose names do not agree is not."""
    benchmark = spark.createDataFrame([(k, item) for k, item, _ in PROBES], "item_id long, text string")
    docs = make(*[(k, text) for k, _, text in PROBES], *[(10 + k, f"Here is one more question.\n{text}. And that is all.") for k, _, text in PROBES], *[(20 + k, f"it is {text.lower()}") for k, text, _ in PROBES], (31, PROBES[2][2].replace("Carol keeps", "Dora keeps")), (32, "Nobody has apples. The shop has 3 pens left to sell"))
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontam.matches(docs, benchmark).collect()}
    assert found == {(1, 1): 2, (2, 2): 2, (3, 3): 6, (11, 1): 2, (12, 2): 2, (13, 3): 6, (21, 1): 0, (22, 2): 0, (23, 3): 0}


def test_many_items_of_one_template(spark, make):
    """Documents and items of one template meet as a class: rows grow with their sum."""
    text = lambda k: f"Name{k} has {k} apples and gives {k + 1} of them to the old man at the station"
    items = spark.createDataFrame([(k, text(k)) for k in range(2000)], "item_id long, text string")
    found = decontam.matches(make(*[(k, f"So they say. {text(k + 5000)}.") for k in range(2000)]), items).collect()
    assert {(r["doc_id"], r["item_id"], r["items"]) for r in found} == {(k, 0, 2000) for k in range(2000)} and len(found) == 2000
