"""op6: normalisation by a character map against a plain loop, and spans of every piece against the texts."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest

from wavelath.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = pieces.SPACE


def trie(rules):
    """A compiled character map of (source, replacement) pairs, bytes both: units placed one after another, each node in a block of 256."""
    block, values = b"", {}
    for source, new in rules.items():
        values[source] = len(block)
        block += new + b"\0"
    prefixes = sorted({s[:k] for s in rules for k in range(len(s) + 1)})
    base = {p: 256 * (k + 1) for k, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 2))

    def unit(prefix, label, index):
        step = index ^ base[prefix]  # from this unit's place to its children's block
        assert step < 1 << 21
        return step << 10 | (prefix in rules) << 8 | label

    units[0] = unit(b"", 0, 0)
    for p in prefixes:
        if p:
            index = base[p[:-1]] ^ p[-1]
            units[index] = unit(p, p[-1], index)
        if p in rules:
            assert 0 not in [x[len(p)] for x in rules if x.startswith(p) and len(x) > len(p)]
            units[base[p]] = 1 << 31 | values[p]
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + block


RULES = {"ﬁ".encode(): b"fi", "½".encode(): "1⁄2".encode(), b"\t": b" ", "　".encode(): b" ", b"ab": b"AB", b"abc": b"", "é".encode(): "é".encode(), b"x  ": b" x "}


class Spec:
    def __init__(self, prefix=True, squeeze=True, escape=True, rules=RULES):
        self.precompiled_charsmap = trie(rules) if rules else b""
        self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces = prefix, squeeze, escape


def plain(text, spec, rules):
    """The normalised bytes with the source byte of each, and the end, character by character."""
    data, out, at = text.encode(), [], 0
    while at < len(data):
        found = max((s for s in rules if data.startswith(s, at)), key=len, default=None)
        length = len(found) if found is not None else len(data[at:].decode()[0].encode())
        out += [(x, at) for x in (rules[found] if found is not None else data[at : at + length])]
        at += length
    end = len(data)
    if spec.remove_extra_whitespaces:
        kept = [x for k, x in enumerate(out) if x[0] != 32 or k and out[k - 1][0] != 32]
        if kept and kept[-1][0] == 32:
            end = next(at for k, (x, at) in enumerate(out) if x == 32 and all(y == 32 for y, _ in out[k:])) if any(x != 32 for x, _ in out) else 0
            kept = kept[:-1]
        out = kept
    if not out:
        return b"", [0]
    space = SPACE.encode() if spec.escape_whitespaces else b" "
    if spec.add_dummy_prefix:
        out = [(32, out[0][1])] + out
    wide = [(y, at) for x, at in out for y in (space if x == 32 else bytes([x]))]
    return bytes(x for x, _ in wide), [at for _, at in wide] + [end]


@pytest.mark.parametrize("rules", [RULES, {}])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_normalising_against_a_plain_loop(prefix, squeeze, escape, rules):
    spec = Spec(prefix, squeeze, escape, rules)
    norm = pieces.Normalizer(spec)
    rng = random.Random(prefix + 2 * squeeze)
    texts = ["", " ", "   ", "ﬁ", "abc", "abcab", "x  x  ", "\t\t", "½é　ﬁabab cab", "😀 ﬁ"]
    texts += ["".join(rng.choice([*"abcx  \t\né½ﬁ　😀中", "ab", "abc", "x  "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        got, starts = norm.aligned(text)
        assert (got.encode(), starts) == plain(text, spec, rules), repr(text)


def test_a_model_with_a_map_encodes_as_the_library():
    """The given model with a character map put in: the library and this encoder see the same normalised text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = trie({k: v for k, v in RULES.items() if v})
    model.normalizer_spec.remove_extra_whitespaces = True
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    norm = pieces.Normalizer(model.normalizer_spec)
    for text in ("ﬁne words and ½ of  them", " abc\tabs é ", "x  y", "中ﬁ文"):
        assert norm.aligned(text)[0] == library.normalize(text)


def test_every_span_of_the_table(spark, sf_dir, rows):
    """Pieces, joined as the library names them, are the source between their begins and ends."""
    tool = pieces.encoder(MODEL)
    expected = {}
    for key, text in rows[:60]:
        data = (text or "").encode()
        ids = tool.decoder.encode(text or "")
        at, begins, ends = -3 if data else 0, [], []  # the blank put in front stands before the text
        for i in ids:
            piece = tool.decoder.id_to_piece(i)
            size = int(tool.decoder.is_byte(i))
            for c in "" if size else piece:
                place = at + size
                size += 3 if place < 0 else 1 if c == SPACE and data[place : place + 1] == b" " else len(c.encode())
            begins.append(max(at, 0))
            at += size
            ends.append(max(at, 0))
        expected[key] = hashlib.sha256(f"{','.join(map(str, begins))};{','.join(map(str, ends))}".encode()).hexdigest()
    found = {r["doc_id"]: r["spans_sha256"] for r in pieces.op6_piece_spans(spark, sf_dir).collect()}
    assert {k: found[k] for k in expected} == expected


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    tool = pieces.Encoder(MODEL)
    monkeypatch.setattr(pieces, "KNOWN", 20_000)
    whole = tool.ids([f"▁word{k}▁and▁{'x' * (k % 50)}" for k in range(500)])[0]
    parts = [tool.ids([f"▁word{k}▁and▁{'x' * (k % 50)}"])[0] for k in range(500)]
    assert tool.held < 40_000 and np.concatenate(parts).tolist() == whole.tolist()


@pytest.mark.parametrize("kind", [1, 2])
def test_unknown_ids_cover_what_no_piece_has(tmp_path, kind):
    """Small models without pieces of bytes, unigram and merges: pieces tile the text, unknown ids of any length too."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    for piece, type_ in [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((p, 1) for p in ("▁the", "▁cat", "▁", "c", "a", "t", "▁t", "he", "th", "at", "ca"))]:
        model.pieces.add(piece=piece, type=type_, score=-len(model.pieces) / 10)
    model.trainer_spec.model_type = kind
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = True
    path = tmp_path / "small.model"
    path.write_bytes(model.SerializeToString())
    tool = pieces.Encoder(str(path))
    for text in ("the ñ cat", "日本 cat", "", "ñññ", "the  cat x", "日本日本 the ñ"):
        ids, _, begins, ends = (a.to_pylist()[0] for a in pieces.encoded(tool, [text], True))
        data = text.encode()
        assert ids == tool.decoder.encode(text)
        assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data
        assert begins == sorted(begins) and all(i != 0 or data[a:b].decode() for i, a, b in zip(ids, begins, ends))
