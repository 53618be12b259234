"""op12 against plain loops over all starts and periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from wavelath.llm import wordruns
from wavelath.llm.wordruns import WordRuns

from .conftest import table_of


def plain(words, min_words=6, min_periods=4):
    """Every run (start, length, period) of a list of words."""
    out, taken = [], set()
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and (n := j - i + q) >= max(min_words, min_periods * q) and not any(q % p == 0 and (s <= i and i + n <= s + m) for s, m, p in taken):
                out.append((i, n, q))
                taken.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = changed(doc_id, text)
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_plain_loops(spark, sf_dir, rows):
    got = table_of(wordruns.op12_word_runs(spark, sf_dir), *COLUMNS)
    assert got == sorted((expected(k, t) for k, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def random_words(rng):
    kind = rng.randrange(5)
    n = rng.randrange(0, 120)
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        base = rng.choices("abc", k=rng.randrange(1, 20))
        return rng.choices("abcd", k=rng.randrange(5)) + (base * 20)[: n] + rng.choices("abcd", k=rng.randrange(5))
    if kind == 2:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == 3:  # runs inside runs
        inner = ["x"] * rng.randrange(1, 9) + rng.choices("yz", k=rng.randrange(3))
        return (inner * rng.randrange(1, 12))[:150]
    out = rng.choices("abcdefgh", k=n)
    for _ in range(3):
        at, p = rng.randrange(n + 1), rng.randrange(1, 12)
        out[at:at] = rng.choices("abc", k=p) * rng.randrange(2, 7)
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 8])
def test_repetitions_against_plain_loops(levels):
    rng = random.Random(levels)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(8)]
        found = wordruns.repetitions([np.array([ord(c) for c in t], np.int64) for t in texts], WordRuns(levels=levels))
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain(t)]


def test_other_bounds():
    rng = random.Random(9)
    for bounds in ((2, 2), (6, 3)):
        texts = [random_words(rng) for _ in range(100)]
        found = wordruns.repetitions([np.array([ord(c) for c in t], np.int64) for t in texts], WordRuns(*bounds, levels=2))
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain(t, *bounds)]


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, "".join(random.Random(3).choices("abcdef", k=9_000)) * 7])
def test_long_repetitions_do_not_cost_the_square(text):
    began = time.perf_counter()
    found = wordruns.repetitions([np.frombuffer(text.encode(), np.uint8).astype(np.int64)])
    assert time.perf_counter() - began < 10
    assert max(found[:, 2]) == len(text)


def test_odd_rows(odd, make):
    found = table_of(wordruns.collapsed(odd), "doc_id", "text")
    assert len(found) == 10 and (1, "") in found and (2, "") in found and (3, "") in found and (None, "") in found
    assert found.count((4, "same words in both rows of this text")) == 2
    assert table_of(wordruns.looped(odd), "doc_id")[0] is not None and wordruns.collapsed(odd.limit(0)).collect() == []
    clash = make((1, "go on go on go on go on end")).selectExpr("doc_id", "text", "lang runs", "source `text.x`")
    (row,) = wordruns.collapsed(clash).collect()
    assert row["text"] == "go on end" and [tuple(r) for r in row["runs"]] == [(0, 8, 2)]
