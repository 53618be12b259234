"""op6 and op9 against the libraries themselves."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelath.llm import pieces, tokencounts
from wavelath.llm.tokencounts import ByteTokens

from .conftest import table_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(library, key, text):
    ids = library.encode(text or "")
    return key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_pieces_against_the_library(spark, sf_dir, rows, library):
    found = pieces.op6_piece_spans(spark, sf_dir)
    assert table_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted((expected(library, *r) for r in rows), key=repr)


ODD = ["", " ", "  two  blanks  ", "\n\n\n", "tab\there", "▁▁ already", "　wide", "ﬁ ½ ①", "😀😀", "a" * 3000, "\x00\x01", "é", "<s> </s> <unk>", "\r\n", "ab ▁cd\n▁ef", "中文字符", "<0x41>"]


def test_odd_texts(make, odd, library):
    for df in (make(*enumerate(ODD)), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        found = pieces.digests(pieces.with_pieces(df, MODEL))
        assert table_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted((expected(library, *r) for r in rows), key=repr)
    assert pieces.with_pieces(odd.limit(0), MODEL).collect() == []


def test_spans_tile_the_source(make):
    for r in pieces.with_pieces(make(*enumerate(ODD)), MODEL).collect():
        data = r["text"].encode()
        assert all(a <= b for a, b in zip(r["begins"], r["ends"]))
        if data:
            assert r["begins"][0] == 0 and r["ends"][-1] == len(data) and r["ends"][:-1] == r["begins"][1:]


def test_clashing_columns_are_replaced(make):
    df = make((1, "words")).withColumn("ids", F.lit("clash"))
    assert pieces.with_pieces(df, MODEL).columns == [*make((1, "")).columns, "ids", "decoded", "begins", "ends"]


def test_alignment_of_a_character_map():
    """A model with a map: the longest prefix is replaced, and every byte of the result knows its source."""
    norm = object.__new__(pieces.Normalizer)
    norm.prefix, norm.squeeze, norm.escape, norm.simple = True, True, True, False

    class Map:
        units = (1,)

        def longest(self, data, at):
            for source, new in ((b"ffi", b"FFI"), (b"ff", b"FF"), (b"\t", b" ")):
                if data.startswith(source, at):
                    return len(source), new
            return None

    norm.map = Map()
    text, starts = norm.aligned(" a\tffi  ff ")
    assert text == "▁a▁FFI▁FF"
    assert starts == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 6, 6, 6, 8, 8, 10]


# --- token counts


def brute_lines(text):
    tool, sizes = tokencounts.encoding(BYTES)
    ids = tool.encode_ordinary(text or "")
    owner = np.repeat(np.arange(len(ids)), sizes[ids])
    data = (text or "").encode()
    line, at = [], 0
    for k, b in enumerate(data):
        line.append(at)
        at += b == 10
    counts, crossing = [0] * (len(set(line))), 0
    place = 0
    for size in sizes[ids]:
        own = line[place : place + size]
        counts[own[(size - 1) // 2]] += 1
        crossing += sum(1 for _ in set(own)) if len(set(own)) > 1 else 0
        place += size
    assert len(owner) == len(data)
    return len(ids), len(counts), crossing, ",".join(map(str, counts))


def test_counts_against_brute_force(spark, sf_dir, rows, odd):
    found = tokencounts.op9_section_tokens(spark, sf_dir)
    columns = ("doc_id", "n_tokens", "n_lines", "n_crossing", "line_tokens")
    assert table_of(found, *columns) == sorted(((k, *brute_lines(t)) for k, t in rows), key=repr)


def test_odd_counts(odd):
    for r in tokencounts.attribute(odd, BYTES, tokencounts.line_starts).collect():
        assert sum(r["tokens"]) == r["n_tokens"]
    assert tokencounts.attribute(odd.limit(0), BYTES, tokencounts.line_starts).collect() == []


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_rules(spark, make, rule):
    text = "The quick brown fox é 😀 jumps"
    cuts = [0, 5, 20, 21, len(text)]
    sections = spark.createDataFrame([(1, f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))] + [(1, "far", 900, 1000), (1, "empty", 4, 4), (None, "lost", 0, 3)], "doc_id long, name string, start int, end int")
    docs = tokencounts.with_sections(make((1, text), (2, None), (3, "no sections")), sections)
    found = {r["doc_id"]: r for r in tokencounts.attribute(docs, BYTES, "sections", rule).collect()}
    got = dict(zip(found[1]["names"], found[1]["tokens"]))
    assert sum(got.values()) == pytest.approx(found[1]["n_tokens"])
    assert got["far"] == got["empty"] == 0
    assert found[2]["n_tokens"] == 0 and found[2]["names"] == [] and found[3]["names"] == []
    # the second token, " quick", begins in s0 and stands mostly in s1
    tool, sizes = tokencounts.encoding(BYTES)
    assert tool.encode_ordinary(text)[1] == tool.encode_ordinary(" quick")[0]
    assert got["s0"] == pytest.approx({"middle": 1, "start": 2, "share": 4 / 3}[rule])
    assert dict(zip(found[1]["names"], found[1]["crossing"]))["s0"] == 1


def test_unknown_rule(make):
    with pytest.raises(ValueError, match="rule is one of"):
        tokencounts.attribute(make((1, "x")), BYTES, tokencounts.line_starts, "none")
