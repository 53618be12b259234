"""op2 against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from wavelath.llm import components, neardup
from wavelath.llm.neardup import NearDuplicates

from .conftest import table_of


def sets(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def brute(rows, size):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    own = [sets(t, size) for _, t in rows]
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = own[i], own[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((k, len(s), find(k), find(k) == k) for (k, _), s in zip(rows, own)), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_against_all_pairs(spark, sf_dir, rows):
    assert table_of(neardup.op2_super_minhash(spark, sf_dir), *COLUMNS) == brute(rows, 4)


def chain(seed=0, count=60):
    """Copies of copies with a few words changed, short texts, ties."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out, at = [], 100
    for _ in range(6):
        text = rng.choices(words, k=rng.choice([12, 60, 150]))
        for _ in range(count // 6):
            out.append((at, " ".join(text)))
            at += rng.randint(1, 3)
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_of_copies(make, seed):
    rows = chain(seed)
    found = neardup.grouped(make(*rows), NearDuplicates(words=4, block=4))
    assert table_of(found, *COLUMNS) == brute(rows, 4)


def test_odd_rows(odd):
    found = {}
    for r in neardup.grouped(odd).collect():
        found.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[1] == found[2][:0] + [(0, 1, True)] and found[2] == [(0, 2, True)] and found[3] == [(0, 3, True)]
    assert found[4] == [(4, 4, True)] * 2
    assert sorted(found[None]) == [(0, None, True), (1, None, True)]
    assert neardup.grouped(odd.limit(0)).collect() == []


def test_representatives_keep_all_columns_and_one_of_each(make, odd):
    from pyspark.sql import functions as F

    docs = make((5, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (9, "other words than those above stand here"), (9, "other words than those above stand here"), (7, None), (7, None))
    kept = neardup.representatives(docs.withColumn("node", F.lit("clash")))
    assert kept.columns == [*docs.columns, "node"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 7, 9]


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    other = np.concatenate([base[:320], rng.integers(0, 1 << 62, 80).astype(np.uint64)])
    s = neardup.super_minhash([np.unique(base), np.unique(other), np.unique(base)], 240)
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.09
    assert (neardup.super_minhash([np.zeros(0, np.uint64)], 8) == np.iinfo(np.uint64).max).all()
    few = neardup.super_minhash([base[:2]], 16)
    assert len(np.unique(few)) <= 32 and (few < np.iinfo(np.uint64).max).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (3, 1), (50, 51), (4, 4)] + [(100 + k, 101 + k) for k in range(40)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert [found[k] for k in (1, 2, 3, 8, 9, 10, 51)] == [1, 1, 1, 8, 8, 8, 50]
    assert all(found[100 + k] == 100 for k in range(41)) and 4 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ids_over_the_whole_range(make):
    top, low = (1 << 63) - 1, -(1 << 63)
    text, other = "one two three four five six seven eight", "other words that stand in no other text here"
    docs = make(((1 << 62) + 5, text), ((1 << 62) + 6, text), (top, other), (low, other), (None, other), (None, text + " nine"), (-3, None), (None, "  "), (7, "a"), (None, "a"))
    found = {}
    for r in neardup.grouped(docs, NearDuplicates(words=4)).collect():
        found.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    first = (1 << 62) + 5
    assert found[first] == [(5, first, True)] and found[first + 1] == [(5, first, False)]
    assert found[low] == [(6, low, True)] and found[top] == [(6, low, False)] and found[-3] == [(0, -3, True)] and found[7] == [(1, 7, True)]
    assert sorted(found[None], key=repr) == sorted([(6, low, False), (6, first, False), (0, None, True), (1, 7, False)], key=repr)
    assert sorted(r["doc_id"] for r in neardup.representatives(docs).collect() if r["doc_id"] is not None) == [low, -3, 7, first]


def test_a_member_with_many_partners_is_dealt_out(spark):
    links = spark.createDataFrame([(1, k) for k in range(2, 3000)] + [(5, 6), (5, 7)], "a long, b long")
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(1, 3000)], "node long, text string")
    both = neardup.beside(links, rows, "text")
    assert sorted((r["a"], r["b"]) for r in both.collect() if (r["x"], r["y"]) == (f"t{r['a']}", f"t{r['b']}")) == sorted((r["a"], r["b"]) for r in links.collect())


def test_links_are_contracted_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"a": [k, k + 1], "b": [k + 1, k + 2]}) for k in range(0, 30, 2)]
    monkeypatch.setattr(components, "PIECE", 6)
    out = list(components._contract(batches))
    assert len(out) == 5 and max(b.num_rows for b in out) <= 6
    joined = components.union([x for b in out for x in b.column(0).to_pylist()], [x for b in out for x in b.column(1).to_pylist()])
    assert set(joined.values()) == {0}
