"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector by hash. A word's context vector is
the sum of the index vectors of its neighbours over the whole corpus. Words are
hashed to a fixed number of rows, so that the vectors are a table of fixed size
whatever the corpus. A document is the mean and the spread of its words'
vectors. A two-layer numpy network is fitted on a bounded sample of labelled
documents; its logits are divided by a temperature fitted on rows held back from
training, so that scores are probabilities.

Words are runs of letters, runs of digits, runs of other signs, and marks for
how a word is written (case, repetition of the word before). Labels, language,
source and ids are never inputs of a score.

Nulls count as empty texts; an empty text is scored by its zero vector. Rows of
labels without a document, or of documents without a label, are not trained on;
a document with several labels counts as often; of rows that repeat a doc_id the
first text in order is trained on, and all are scored. Without a label of each class
every score is the share of label 1, or 0.5 where nothing is known.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, pieces, table

WORDS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n|[^\sA-Za-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class QualityModel:
    #: Rows of the word table and length of the vectors.
    rows: int = 1 << 14
    dims: int = 32
    #: Nonzero entries of an index vector.
    marks: int = 4
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 0.01
    decay: float = 1e-4
    #: Labelled documents that the network is fitted on, at most; the smallest hashes of doc_id are taken.
    sample: int = 12_000
    #: A document counts as good from this score on.
    threshold: float = 0.7
    seed: int = 1


def index_vectors(model: QualityModel) -> np.ndarray:
    """A sparse vector of -1, 0 and 1 for each row of the word table, by rule."""
    out = np.zeros((model.rows, model.dims), np.float32)
    ids = np.arange(model.rows, dtype=np.uint64)
    for k in range(model.marks):
        h = mix64(ids * np.uint64(model.marks) + np.uint64(k) + np.uint64(model.seed << 32))
        np.add.at(out, (np.arange(model.rows), (h % np.uint64(model.dims)).astype(int)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


class Words(dict):
    """The row of each word as it is met; forgets when it grows, since a row is a function of the word alone."""

    def __init__(self, rows: int):
        self.rows = rows

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        # a word counts apart by whether it is all capitals, begins with one, or neither
        form = b"^" if word.isupper() and len(word) > 1 else b"'" if word[:1].isupper() else b""
        low = word.lower()
        found = zlib.crc32(form + b"/" + low) % self.rows
        self[word] = found
        return found


REPEAT = zlib.crc32(b"//repeat")


def rows_of(text: bytes, words: Words) -> np.ndarray:
    """The word rows of a text; a word that repeats the one before is followed by a mark."""
    got = np.fromiter(map(words.__getitem__, WORDS.findall(text)), np.int64)
    if len(got) > 1:
        again = np.flatnonzero(got[1:] == got[:-1]) + 2
        got = np.insert(got, again, REPEAT % words.rows)
    return got


def word_vectors(docs: DataFrame, model: QualityModel, column: str = "text") -> np.ndarray:
    """The context vectors, of rows times dims numbers at any size of the corpus."""

    def contexts(batches):
        index, words = index_vectors(model), Words(model.rows)
        total = np.zeros((model.rows, model.dims), np.float64)
        for batch in pieces(batches, 256):
            parts = [rows_of((x or "").encode(), words) for x in batch.column(column).to_pylist()]
            ids = np.concatenate([np.zeros(0, np.int64), *parts])
            if not len(ids):
                continue
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            around = np.zeros((len(ids), model.dims), np.float32)
            for d in range(1, model.window + 1):
                near = (owner[d:] == owner[:-d])[:, None]
                around[d:] += index[ids[:-d]] * near
                around[:-d] += index[ids[d:]] * near
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            total[ids[order][first]] += np.add.reduceat(around[order], first, axis=0)
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.float32).tolist(), pa.list_(pa.float32()))], ["row", "sums"])

    got = docs.select(column).mapInArrow(contexts, "row long, sums array<float>")
    # whole numbers below 2**24 a part: the sums do not depend on their order
    summed = got.groupBy("row").agg(*[F.sum(F.col("sums")[k].cast("double")).alias(f"d{k}") for k in range(model.dims)]).toPandas()
    out = np.zeros((model.rows, model.dims))
    out[summed["row"].to_numpy(np.int64)] = summed.drop(columns="row").to_numpy()
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray, words: Words) -> np.ndarray:
    """Mean and spread of a text's word vectors."""
    ids = rows_of(text, words)
    if not len(ids):
        return np.zeros(2 * vectors.shape[1], np.float32)
    seen, counts = np.unique(ids, return_counts=True)
    share = (counts / len(ids)).astype(np.float32)
    mean = share @ vectors[seen]
    return np.concatenate([mean, np.sqrt(np.maximum(share @ vectors[seen] ** 2 - mean**2, 0))])


@dataclass
class Network:
    """Two layers: tanh, then one logit; inputs are standardised, logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, model: QualityModel) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature has the least log loss on the last fifth."""
    dims = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        logit = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), logit)
    rng = np.random.default_rng(model.seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(held) or y[used].min() == y[used].max():
        held, used = order, order
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, dims**-0.5, (dims, model.hidden)), np.zeros(model.hidden), rng.normal(0, model.hidden**-0.5, model.hidden), 0.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([float(np.log(y[used].mean() / (1 - y[used].mean())))])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(model.epochs):
        rate = model.rate * 0.5 * (1 + np.cos(np.pi * epoch / model.epochs))
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), 256):
            rows = mixed[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + model.decay * params[0], back.sum(0), h.T @ error + model.decay * params[2], np.array([error.sum()])]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    logits, truth = net.logits(x[held]), y[held]
    tries = np.geomspace(0.25, 8, 61)
    losses = [np.mean(np.logaddexp(0, np.where(truth > 0, -logits, logits) / t)) for t in tries]
    net.temperature = float(tries[int(np.argmin(losses))])
    return net


def held_out(key: str = "doc_id"):
    """Rows that are never trained on: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, model: QualityModel = QualityModel(), column: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and the network from the bounded sample of labelled ones."""
    vectors = word_vectors(docs, model, column)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        words = Words(model.rows)
        for batch in pieces(batches, 256):
            x = [pooled((t or "").encode(), shared.value, words).tolist() for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), pa.array(x, pa.list_(pa.float32()))], ["order", "quality", "x"])

    drawn = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id", "quality")
        .limit(model.sample)
    )
    # the sample is bounded by the model's setting, so it is the side that every executor may hold
    # one text for each id, so that rows which repeat an id add nothing to what is fitted on
    texts = docs.select("doc_id", column).join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(column).alias(column))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("order", "quality", column)
    got = rows.mapInArrow(features, "order long, quality int, x array<float>").toPandas()
    got["first"] = [x[0] for x in got["x"]]
    got = got.sort_values(["order", "quality", "first"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), 2 * model.dims)
    return vectors, fit_network(x, got["quality"].to_numpy(np.float64), model)


def score(docs: DataFrame, vectors: np.ndarray, net: Network, model: QualityModel = QualityModel(), column: str = "text") -> DataFrame:
    """The rows of docs with score and predicted, in place of columns of their names."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        (table, network), words = shared.value, Words(model.rows)
        for batch in pieces(batches, 256):
            x = np.array([pooled((t or "").encode(), table, words) for t in batch.column(column).to_pylist()], np.float64).reshape(batch.num_rows, 2 * model.dims)
            s = network.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= model.threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op10_random_indexing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors, net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), vectors, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
