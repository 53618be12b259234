"""op11 against all pairs by brute force."""

import itertools
import random

import numpy as np
import pytest

from wavelath.llm import ngramjoin
from wavelath.llm.ngramjoin import NGramJoin, Segments

from .conftest import table_of
from .test_neardup import sets

COLUMNS = ("doc_id", "n_shingles", "component_id")


def brute(rows, words=3, percent=90):
    own = [sets(t, words) for _, t in rows]
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = own[i], own[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((k, len(s), find(k)) for (k, _), s in zip(rows, own)), key=repr)


def test_table_against_all_pairs(spark, sf_dir, rows):
    got = table_of(ngramjoin.op11_ngram_join(spark, sf_dir), *COLUMNS)
    assert got == brute(rows) and any(k != c for k, _, c in got)


def copies(seed, lengths=(10, 13, 40, 200), count=30, edits=3):
    """Copies of copies with words put in, left out or changed, passages that unlike texts share, ties."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=60)
    out, at = [], 1
    for length in lengths:
        base = rng.choices(words, k=length)
        text = base
        for k in range(count):
            text = list(base if k % 3 else text)
            for _ in range(rng.randint(0, edits)):
                place = rng.randrange(len(text))
                text[place : place + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            out.append((at, " ".join(text)))
            at += rng.randint(1, 3)
        for _ in range(count // 3):
            out.append((at, " ".join(rng.choices(words, k=rng.randrange(2, 60)) + passage)))
            at += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_copies_against_all_pairs(make, seed):
    rows = copies(seed)
    assert table_of(ngramjoin.joined(make(*rows), NGramJoin(bucket=16 if seed else 2)), *COLUMNS) == brute(rows)


def test_a_large_group_of_unlike_copies(make):
    """Every bucket is large, and no member is alike to most others: allotments decide."""
    rows = copies(7, lengths=(60, 90), count=150, edits=4)
    assert table_of(ngramjoin.joined(make(*rows), NGramJoin(bucket=2)), *COLUMNS) == brute(rows)


def test_allotments_miss_no_pair(spark):
    """The pairs that allotments bring up, of texts that all share segments, hold all links; and far fewer than all pairs."""
    rows = copies(11, lengths=(30, 60, 120), count=80, edits=3)
    met = {(r["a"], r["b"]) for r in ngramjoin.allotted(spark.createDataFrame([(k, t, k, True) for k, t in rows], "node long, text string, component long, asks boolean"), NGramJoin()).collect()}
    own = {k: sets(t, 3) for k, t in rows}
    links = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if own[a] != own[b] and 100 * len(own[a] & own[b]) >= 90 * len(own[a] | own[b])}
    assert links <= met and len(links) > 100 and len(met) < len(own) * (len(own) - 1) // 4


def test_copies_with_changes_of_their_own_do_not_meet(spark):
    """A large group of copies, each changed in its own way and most of them unlike: few pairs are brought up, and all links among them."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts: list[list[str]] = []
    for k in range(300):
        text = list(base if k % 10 else texts[-1] if texts else base)
        for _ in range(rng.randint(4, 6) if k % 10 else 1):
            place = rng.randrange(len(text))
            text[place : place + 1] = [] if rng.random() < 0.5 else [rng.choice(base)]
        texts.append(text)
    rows = [(k, " ".join(t), k, True) for k, t in enumerate(texts)]
    met = {(r["a"], r["b"]) for r in ngramjoin.allotted(spark.createDataFrame(rows, "node long, text string, component long, asks boolean"), NGramJoin()).collect()}
    own = [sets(t, 3) for _, t, _, _ in rows]
    links = {(a, b) for a, b in itertools.combinations(range(len(own)), 2) if own[a] != own[b] and 100 * len(own[a] & own[b]) >= 90 * len(own[a] | own[b])}
    assert links <= met and len(links) > 20 and len(met) < 20 * len(own)


def test_other_bounds(make):
    rows = copies(3, lengths=(8, 30, 70), count=24)
    for words, percent in ((2, 75), (1, 60)):
        assert table_of(ngramjoin.joined(make(*rows), NGramJoin(words=words, percent=percent, bucket=3)), *COLUMNS) == brute(rows, words, percent)


def test_pairs_within_the_bound_share_a_segment():
    """The pigeonhole itself, on sets at the bound."""
    rng = np.random.default_rng(1)
    settings = NGramJoin()
    for size in (9, 10, 11, 17, 18, 40, 333):
        for _ in range(20):
            r = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            worst = int((100 - settings.percent) * len(r) / settings.percent)
            s = np.unique(np.append(r, rng.integers(0, 1 << 63, worst).astype(np.uint64)))
            parts = Segments([r, s], settings, 1, 0)
            keys = parts.keys()
            of = parts.set[parts.view]
            assert set(keys[of == 0]) & set(keys[of == 1])


def test_cheapest_against_all_allotments():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        once = rng.integers(0, 9, n).astype(float)
        twice = once + rng.integers(0, 9, n)
        for needed in range(1, 2 * n + 1):
            cost = lambda a: sum(0 if p == 0 else once[k] if p == 1 else twice[k] for k, p in enumerate(a))
            best = min(cost(a) for a in itertools.product(range(3), repeat=n) if sum(a) >= needed)
            found = ngramjoin.cheapest(once, twice, needed)
            assert found.sum() >= needed and cost(found.tolist()) == best


def test_odd_rows(odd, make):
    found = table_of(ngramjoin.joined(odd), *COLUMNS)
    assert (1, 0, 1) in found and (2, 0, 2) in found and (3, 0, 3) in found and found.count((4, 6, 4)) == 2
    assert sorted(n for k, n, c in found if k is None) == [0, 3] and ngramjoin.joined(odd.limit(0)).collect() == []
    assert table_of(ngramjoin.joined(make((5, "One two"), (3, "one  TWO"), (9, "one two three"), (4, "À b"), (6, "à b"))), *COLUMNS) == [(3, 1, 3), (4, 1, 4), (5, 1, 3), (6, 1, 6), (9, 1, 9)]
    clash = make((1, "a b c d"), (2, "a b c d")).selectExpr("doc_id", "text", "lang node", "source name", "n_chars own")
    assert table_of(ngramjoin.joined(clash), *COLUMNS) == [(1, 2, 1), (2, 2, 1)]
