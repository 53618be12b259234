"""Learners against plain numpy, known sources and separated clusters."""

import numpy as np
import pytest

from wavelath.operators import learners
from wavelath.operators.learners import Mixture


def table(spark, x):
    return spark.createDataFrame([(k, None if r is None else [float(v) for v in r]) for k, r in enumerate(x)], "id long, x array<double>").repartition(3)


def out(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()], float)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    return rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + rng.normal(size=5)


@pytest.mark.parametrize("cov_type", ["sample", "unbiased", "correlation"])
@pytest.mark.parametrize("sort", ["ascending", "descending"])
def test_pca(spark, points, cov_type, sort):
    found = learners.pca(table(spark, [*points, None]), 3, cov_type, sort)
    cov = {"sample": np.cov(points.T, bias=True), "unbiased": np.cov(points.T), "correlation": np.corrcoef(points.T)}[cov_type]
    values, vectors = np.linalg.eigh(cov)
    at = [2, 3, 4] if sort == "ascending" else [4, 3, 2]
    np.testing.assert_allclose(found.values, values[at], rtol=1e-8)
    np.testing.assert_allclose(np.abs(np.sum(found.directions * vectors[:, at].T, axis=1)), 1, rtol=1e-8)
    np.testing.assert_allclose(found.mean, points.mean(0))


def test_pca_columns(spark, points):
    df = table(spark, points)
    found = learners.pca(df, 5)
    white = out(df.select("id", found.whiten("x").alias("y")), "y")
    np.testing.assert_allclose(np.cov(white.T, bias=True), np.eye(5), atol=1e-8)
    np.testing.assert_allclose(out(df.select("id", found.center("x").alias("y")), "y"), points - points.mean(0), atol=1e-12)
    np.testing.assert_allclose(out(df.select("id", found.transform("x").alias("y")), "y") @ found.directions + found.mean, points, atol=1e-8)
    with pytest.raises(ValueError):
        learners.pca(df.limit(3), 5)
    with pytest.raises(ValueError):
        learners.pca(df.limit(0), 1)


@pytest.mark.parametrize("func", ["logcosh", "gauss"])
def test_ica_finds_its_sources(spark, func):
    t = np.arange(2000) / 2000
    sources = np.stack([np.sin(2 * np.pi * 13 * t), np.sign(np.sin(2 * np.pi * 7 * t)), 2 * (t * 17 % 1) - 1], axis=1)
    mixed = sources @ np.array([[1.0, 1, 1], [0.5, 2, 1], [1.5, 1, 2]])
    df = table(spark, mixed)
    found = out(df.select("id", learners.ica(df, 3, func, seed=1).transform("x").alias("y")), "y")
    match = np.abs(np.corrcoef(sources.T, found.T)[:3, 3:])
    assert (match.max(axis=1) > 0.98).all() and sorted(match.argmax(axis=1)) == [0, 1, 2]


CENTRES = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10]])


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    return np.concatenate([c + rng.normal(size=(60, 2)) * 0.5 for c in CENTRES])


def test_lbg(spark, clusters):
    df = table(spark, [*clusters, None])
    found = learners.lbg(df, 4, seed=0, perturb_factor=1.0)
    means = np.array([clusters[k * 60 : (k + 1) * 60].mean(0) for k in range(4)])
    order = [int(np.argmin(((found.words - m) ** 2).sum(1))) for m in means]
    np.testing.assert_allclose(found.words[order], means, atol=1e-8)
    np.testing.assert_allclose(found.counts[order], [60] * 4)
    assert found.distance == pytest.approx(np.mean([((clusters[k * 60 : (k + 1) * 60] - m) ** 2).sum(1).mean() for k, m in enumerate(means)]))
    index = out(df.filter("x IS NOT NULL").select("id", found.transform("x").alias("q")), "q")
    assert [int(index[k * 60]) for k in range(4)] == order
    three = learners.lbg(df, 3, seed=0, perturb_factor=1.0)
    assert three.words.shape == (3, 2) and three.distance > found.distance
    lonely = learners.lbg(df, 4, min_data_per_cluster=100, n_iter=5, seed=0)
    assert lonely.words.shape == (4, 2) and np.isfinite(lonely.words).all()


def plain_em(x, w, m, c, mask, rounds, floor=1e-6, ubm=None, alpha=0.0):
    for _ in range(rounds):
        p = np.stack([w[k] * np.exp(-0.5 * np.einsum("nd,de,ne->n", x - m[k], np.linalg.inv(c[k]), x - m[k])) / np.sqrt(np.linalg.det(2 * np.pi * c[k])) for k in range(len(w))], axis=1)
        likelihood = np.log(p.sum(1)).mean()
        p /= p.sum(1, keepdims=True)
        size = p.sum(0)
        w = np.maximum(size / len(x), 1e-5)
        w /= w.sum()
        first = p.T @ x
        m = first / size[:, None] if not alpha else (first + alpha * ubm.weights[:, None] * ubm.means) / (size + alpha * ubm.weights)[:, None]
        c = np.stack([((x - m[k]).T * p[:, k]) @ (x - m[k]) / size[k] * mask for k in range(len(w))])
        for k in range(len(w)):
            np.fill_diagonal(c[k], np.maximum(np.diag(c[k]), floor))
    return w, m, c, likelihood


@pytest.mark.parametrize("var_type, blocks, mask", [
    ("diag", None, np.eye(3)), ("full", None, np.ones((3, 3))), ("full", [2, 1], [[1, 1, 0], [1, 1, 0], [0, 0, 1]]), ("diag", [2, 1], np.eye(3)), ("diag", [1, 1, 1], np.ones((3, 3))),
])
def test_gmm_against_plain_rounds(spark, var_type, blocks, mask):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 2])
    start = Mixture(np.array([0.4, 0.6]), x[[0, 100]], np.stack([np.eye(3)] * 2))
    found = learners.gmm(table(spark, [*x, None]), 2, n_iter=4, eps=-np.inf, var_type=var_type, block_size=blocks, start=start)
    w, m, c, likelihood = plain_em(x, start.weights, start.means, start.covariances, np.array(mask), 4)
    np.testing.assert_allclose(found.weights, w, rtol=1e-7)
    np.testing.assert_allclose(found.means, m, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(found.covariances, c, rtol=1e-6, atol=1e-8)
    assert found.log_likelihood == pytest.approx(likelihood)


def test_gmm_towards_a_ubm(spark):
    x = np.random.default_rng(3).normal(size=(50, 2))
    ubm = Mixture(np.array([0.5, 0.5]), np.array([[1.0, 0], [-1, 0]]), np.stack([np.eye(2)] * 2))
    found = learners.gmm(table(spark, x), 2, n_iter=2, eps=-np.inf, ubm=ubm, alpha=0.8)
    w, m, _, _ = plain_em(x, ubm.weights, ubm.means, ubm.covariances, np.eye(2), 1, ubm=ubm, alpha=0.8)
    once = learners.gmm(table(spark, x), 2, n_iter=1, ubm=ubm, alpha=0.8)
    np.testing.assert_allclose(once.means, m, rtol=1e-7)
    np.testing.assert_allclose(once.weights, w, rtol=1e-7)
    assert np.isfinite(found.means).all()
    with pytest.raises(ValueError):
        learners.gmm(table(spark, x), 2, alpha=0.5)


def test_gmm_from_a_codebook(spark, clusters):
    df = table(spark, clusters)
    found = learners.gmm(df, 4, n_iter=20, seed=0)
    assert found.means.shape == (4, 2) and found.weights.sum() == pytest.approx(1)
    posterior = out(df.select("id", found.posteriors("x").alias("p")), "p")
    np.testing.assert_allclose(posterior.sum(1), 1)
    assert (out(df.select("id", found.transform("x").alias("k")), "k") == posterior.argmax(1)).all()


def test_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    both = np.column_stack([x, x @ [1.5, -2] + 3 + 0.01 * rng.normal(size=400)])
    model = learners.gmm(table(spark, both), 1, n_iter=3, var_type="full", seed=0)
    found = out(table(spark, x).select("id", model.regression("x").alias("y")), "y")
    np.testing.assert_allclose(found[:, 0], both[:, 2], atol=0.06)


@pytest.mark.parametrize("beta", [0, 1, 2, 0.5, 3])
@pytest.mark.parametrize("act_norm", [False, True])
def test_nmf(spark, beta, act_norm):
    rng = np.random.default_rng(5)
    u, h = rng.random((40, 2)) + 0.05, rng.random((2, 6)) + 0.05
    if act_norm:
        u /= u.sum(1, keepdims=True)
    x = u @ h
    df = table(spark, x)
    few, many = (learners.nmf(df, 2, beta, n_iter=n, eps=0, act_norm=act_norm, seed=3) for n in (2, 25))
    assert many.divergence < few.divergence
    own = out(many.activations, "u")
    assert (own >= 0).all() and (many.components >= 0).all() and np.abs(own @ many.components - x).mean() < 0.15
    if act_norm:
        np.testing.assert_allclose(own.sum(1), 1)


def test_one_round_of_nmf_against_a_plain_one(spark):
    """The components after one round, from the activations that the same components give."""
    x = np.random.default_rng(6).random((30, 4)) + 0.1
    found = learners.nmf(table(spark, x), 2, beta=1, n_iter=1, inner=1, seed=0)
    rng = np.random.default_rng(0)
    h = rng.random((2, 4)) + 0.1
    u = np.full((30, 2), x.mean() / 2 / h.mean())
    for _ in range(20):
        u = u * (((x / (u @ h)) @ h.T) / h.sum(1))
    new = h * (u.T @ (x / (u @ h))) / u.sum(0)[:, None]
    np.testing.assert_allclose(found.components, new, rtol=1e-6)


def test_quantisers(spark):
    x = np.array([[0.2, 0.1], [1.1, 1.2], [5.0, 5.0], [0.5, 0.5]])
    book = np.array([[0.0, 0], [1, 1]])
    df = table(spark, x)
    assert out(df.select("id", learners.vq("x", book).alias("q")), "q").tolist() == [0, 1, 1, 0]
    stages = np.stack([book, book / 10])
    coded = df.select("id", learners.msvq("x", stages).alias("q"))
    assert out(coded, "q").tolist() == [[0, 1], [1, 1], [1, 1], [0, 1]]
    np.testing.assert_allclose(out(coded.select("id", learners.imsvq("q", stages).alias("y")), "y"), [[0.1, 0.1], [1.1, 1.1], [1.1, 1.1], [0.1, 0.1]])
