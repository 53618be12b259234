"""op1 against the stored payload computed directly."""

import hashlib
import random
import zlib

import pytest

from wavelath.llm import chunking
from wavelath.llm.chunking import Chunker

from .conftest import table_of

COLUMNS = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
    media = chunking.wav_header(len(payload)) + payload
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()


def test_against_direct_payloads(spark, sf_dir, rows):
    found = chunking.op1_payload_chunks(spark, sf_dir)
    assert table_of(found, *COLUMNS) == sorted(((k, *expected(t)) for k, t in rows), key=repr)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = chunking.describe(chunking.restore(*chunking.store(chunking.with_payload(odd))))
    assert table_of(found, *COLUMNS) == sorted(((k, *expected(t)) for k, t in rows), key=repr)
    features = {}
    for r in found.collect():
        features.setdefault(r["payload_sha256"], set()).add(r["feature"])
    assert all(len(f) == 1 for f in features.values())


def test_empty_table(odd):
    empty = chunking.with_payload(odd.limit(0))
    assert chunking.describe(chunking.restore(*chunking.store(empty))).collect() == []


def test_equal_passages_share_chunks(make):
    passage = "".join(random.Random(0).choices("abcdefgh ", k=40_000))
    lists, chunks = chunking.store(chunking.with_payload(make((1, "head" + passage), (2, "another beginning " + passage), (3, "alone"))))
    kept = {r["doc_id"]: r for r in lists.collect()}
    assert sum(n is not None for n in kept[1]["names"]) > len(kept[1]["names"]) // 2
    assert kept[3]["names"] == [None]
    assert chunks.count() == len({bytes(n) for r in kept.values() for n in r["names"] if n})


def test_cuts_depend_on_content_alone():
    data = random.Random(0).randbytes(60_000)
    c = Chunker()
    assert b"".join(c.chunks(data)) == data
    assert all(len(x) <= c.max_size for x in c.chunks(data))
    shifted = set(c.chunks(b"some words ahead" + data))
    assert len(shifted & set(c.chunks(data))) >= len(c.chunks(data)) - 3
    assert c.chunks(b"") == []


def test_a_damaged_chunk_is_an_error(make):
    lists, _ = chunking.store(chunking.with_payload(make((1, "a text"))))
    from pyspark.sql import functions as F

    broken = lists.withColumn("kept", F.lit(b" " * 192))
    with pytest.raises(Exception, match="differs from the stored one"):
        chunking.restore(broken, _).collect()
