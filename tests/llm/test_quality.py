"""op10 against plain loops: word vectors, pooling, the network's scores."""

import re
import zlib

import numpy as np
import pytest

from wavelath.llm import quality
from wavelath.llm.quality import QualityModel

MODEL = QualityModel(rows=64, dims=8, marks=3, window=2)
TEXTS = ["The quick fox. The QUICK fox!", "one one one\ntwo 22 two", None, "", "Ünïcode wörds 😀 and more words", "a b c d e f g a b c"]


def plain_rows(text, rows):
    out, before = [], None
    for word in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n|[^\sA-Za-z0-9\x80-\xff]+", (text or "").encode()):
        form = b"^" if word.isupper() and len(word) > 1 else b"'" if word[:1].isupper() else b""
        row = zlib.crc32(form + b"/" + word.lower()) % rows
        out.append(row)
        if row == before:
            out.append(zlib.crc32(b"//repeat") % rows)
        before = row
    return out


def plain_vectors(texts, model):
    index = quality.index_vectors(model)
    total = np.zeros((model.rows, model.dims))
    for text in texts:
        ids = plain_rows(text, model.rows)
        for k, row in enumerate(ids):
            for d in range(1, model.window + 1):
                if k - d >= 0:
                    total[row] += index[ids[k - d]]
                if k + d < len(ids):
                    total[row] += index[ids[k + d]]
    return np.array([v / np.linalg.norm(v) if v.any() else v for v in total])


def test_index_vectors_are_sparse():
    index = quality.index_vectors(MODEL)
    assert (np.abs(index).sum(1) <= MODEL.marks).all() and (np.abs(index).sum(1) % 2 == MODEL.marks % 2).all()


def test_word_vectors_against_plain_loops(make):
    docs = make(*enumerate(TEXTS)).repartition(3)
    np.testing.assert_allclose(quality.word_vectors(docs, MODEL), plain_vectors(TEXTS, MODEL), atol=1e-6)


@pytest.mark.parametrize("text", TEXTS)
def test_pooling_against_plain_loops(text):
    vectors = plain_vectors(TEXTS, MODEL).astype(np.float32)
    own = vectors[plain_rows(text, MODEL.rows)]
    expected = np.concatenate([own.mean(0), own.std(0)]) if len(own) else np.zeros(16)
    np.testing.assert_allclose(quality.pooled((text or "").encode(), vectors, quality.Words(MODEL.rows)), expected, atol=2e-4)


def test_scores_against_plain_loops(spark, make):
    docs = make(*enumerate(TEXTS))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    vectors, net = quality.fit(docs, labels, MODEL)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, net, MODEL).collect()}
    for k, text in enumerate(TEXTS):
        own = vectors[plain_rows(text, MODEL.rows)].astype(float)
        x = np.concatenate([own.mean(0), own.std(0)]) if len(own) else np.zeros(16)
        h = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1)
        assert found[k] == pytest.approx(1 / (1 + np.exp(-(h @ net.w2 + net.b2) / net.temperature)), abs=0.02)


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + rng.normal(size=500) > 0).astype(float)
    net = quality.fit_network(x, y, QualityModel(hidden=16))
    held = np.random.default_rng(1).permutation(500)[:100]
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[held] > 0, -net.logits(x[held]), net.logits(x[held])) / t))
    assert loss(net.temperature) <= min(loss(t) for t in (0.3, 0.5, 1, 2, 4, 7)) + 1e-9


def test_repeated_ids_do_not_grow_the_sample(spark, make, monkeypatch):
    seen = []
    whole = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda x, y, model: (seen.append(len(y)), whole(x, y, model))[1])
    docs = make(*[(1, f"text number {k}") for k in range(50)], (3, "other text"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels, MODEL)
    assert seen and seen[0] <= 2
