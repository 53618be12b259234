"""Codebooks, mixtures and factorisations: one distributed aggregation for each iteration.

What an iteration needs from the data is sums. Each task adds up its own rows in
numpy and hands on one row of sums; those are added by place, and the driver
solves for the new parameters, whose size does not depend on the number of rows.
The input is read once for each iteration: cache it, or keep it in Parquet.

Rows with a null vector take part in nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import batched, require


def totals(vectors: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str = "x") -> np.ndarray:
    """The sum over all rows of fn(matrix of rows), a vector of fixed length."""

    def run(batches):
        summed = None
        for batch in batches:
            part = batch.column(0).drop_null()
            if len(part):
                got = fn(part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1))
                summed = got if summed is None else summed + got
        values = np.zeros(0) if summed is None else summed
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values, pa.float64())], ["place", "value"])

    sums = vectors.select(column).mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    rows = sums.toPandas().sort_values("place")  # as many rows as there are sums
    return rows["value"].to_numpy()


def first_rows(vectors: DataFrame, count: int, seed: int, column: str = "x") -> np.ndarray:
    """count vectors, drawn by hash: the same ones however the rows are dealt out."""
    rows = vectors.filter(F.col(column).isNotNull()).select(column, F.xxhash64(F.lit(seed), column).alias("_order")).orderBy("_order", column).limit(count).collect()
    return np.array([r[0] for r in rows], float)


# --- principal and independent components


@dataclass(frozen=True)
class PCA:
    """Values s (falling or rising), directions V as rows, mean m."""

    values: np.ndarray
    directions: np.ndarray
    mean: np.ndarray

    def transform(self, x: Column | str) -> Column:
        return batched(lambda v: (v - self.mean) @ self.directions.T, x)

    def center(self, x: Column | str) -> Column:
        return batched(lambda v: v - self.mean, x)

    def whiten(self, x: Column | str) -> Column:
        return batched(lambda v: (v - self.mean) @ self.directions.T / np.sqrt(self.values), x)


def moments(vectors: DataFrame, column: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, sum, and sum of outer products."""

    def sums(v: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(v)], v.sum(0), (v.T @ v).reshape(-1)])

    got = totals(vectors, sums, column)
    require(there_are_no_vectors=len(got) > 0)
    dims = int(round((np.sqrt(4 * len(got) - 3) - 1) / 2))
    return got[0], got[1 : dims + 1], got[dims + 1 :].reshape(dims, dims)


def pca(vectors: DataFrame, n_comp: int, cov_type: str = "sample", sort: str = "descending", column: str = "x") -> PCA:
    count, total, square = moments(vectors, column)
    require(more_rows_than_components_are_needed=count > n_comp, sort_is_ascending_or_descending=sort in ("ascending", "descending"))
    mean = total / count
    cov = square / count - np.outer(mean, mean)
    if cov_type == "unbiased":
        cov *= count / (count - 1)
    elif cov_type == "correlation":
        scale = np.sqrt(np.diag(cov))
        cov = cov / np.outer(scale, scale)
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n_comp]
    order = order[::-1] if sort == "ascending" else order
    return PCA(values[order], vectors_.T[order], mean)


@dataclass(frozen=True)
class ICA:
    """A rotation of whitened components."""

    whitener: PCA
    rotation: np.ndarray

    def transform(self, x: Column | str) -> Column:
        w = self.whitener
        return batched(lambda v: (v - w.mean) @ w.directions.T / np.sqrt(w.values) @ self.rotation.T, x)


def ica(vectors: DataFrame, n_comp: int, func: str = "logcosh", n_iter: int = 100, eps: float = 1e-4, seed: int | None = None, column: str = "x") -> ICA:
    """Symmetric fixed-point iteration on whitened vectors."""
    require(func_is_logcosh_or_gauss=func in ("logcosh", "gauss"))
    w = pca(vectors, n_comp, column=column)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_comp, n_comp)))[0]
    for _ in range(n_iter):

        def sums(v: np.ndarray, r: np.ndarray = rotation) -> np.ndarray:
            z = (v - w.mean) @ w.directions.T / np.sqrt(w.values)
            u = z @ r.T
            if func == "logcosh":
                g = np.tanh(u)
                slope = 1 - g * g
            else:
                bell = np.exp(-0.5 * u * u)
                g, slope = u * bell, (1 - u * u) * bell
            return np.concatenate([[len(v)], slope.sum(0), (g.T @ z).reshape(-1)])

        got = totals(vectors, sums, column)
        step = (got[n_comp + 1 :].reshape(n_comp, n_comp) - got[1 : n_comp + 1, None] * rotation) / got[0]
        left, _, right = np.linalg.svd(step)
        new = left @ right
        moved = np.max(np.abs(np.abs(np.sum(new * rotation, axis=1)) - 1))
        rotation = new
        if moved < eps:
            break
    return ICA(w, rotation)


# --- codebooks


def square_distances(v: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] - 2 * v @ codebook.T + (codebook * codebook).sum(1), 0)


def vq(x: Column | str, codebook: np.ndarray) -> Column:
    """The number of the nearest codeword, as a double; of equally near ones the first."""
    fixed = np.asarray(codebook, float)
    return batched(lambda v: square_distances(v, fixed).argmin(1).astype(float), x, returns="double").cast("long")


def ivq(index: Column | str, codebook: np.ndarray) -> Column:
    fixed = np.asarray(codebook, float)
    return batched(lambda k: fixed[k.astype(int)], index)


def msvq(x: Column | str, codebooks: np.ndarray) -> Column:
    """Numbers of the codewords of each stage; every stage codes what the ones before left over."""
    fixed = np.asarray(codebooks, float)

    def run(v: np.ndarray) -> np.ndarray:
        rest, out = v, []
        for book in fixed:
            k = square_distances(rest, book).argmin(1)
            out.append(k)
            rest = rest - book[k]
        return np.stack(out, axis=1)

    return F.transform(batched(run, x), lambda k: k.cast("long"))


def imsvq(indices: Column | str, codebooks: np.ndarray) -> Column:
    fixed = np.asarray(codebooks, float)
    own = F.transform(F.col(indices) if isinstance(indices, str) else indices, lambda k: k.cast("double"))
    return batched(lambda k: sum(book[k[:, s].astype(int)] for s, book in enumerate(fixed)), own)


@dataclass(frozen=True)
class Codebook:
    words: np.ndarray
    distance: float
    counts: np.ndarray

    def transform(self, x: Column | str) -> Column:
        return vq(x, self.words)


def assigned(vectors: DataFrame, words: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each codeword: number and sum of the vectors nearest to it; and the mean square distance of all."""
    size, dims = words.shape

    def sums(v: np.ndarray) -> np.ndarray:
        d = square_distances(v, words)
        k = d.argmin(1)
        out = np.zeros((size, dims + 1))
        np.add.at(out, k, np.column_stack([np.ones(len(v)), v]))
        return np.concatenate([[d[np.arange(len(v)), k].sum()], out.reshape(-1)])

    got = totals(vectors, sums, column)
    table = got[1:].reshape(size, dims + 1)
    return table[:, 0], table[:, 1:], got[0] / table[:, 0].sum()


def lbg(vectors: DataFrame, codebook_size: int, min_data_per_cluster: int = 1, n_iter: int = 100, eps: float = 1e-5, perturb_factor: float = 1e-5, seed: int | None = None, column: str = "x") -> Codebook:
    """A codebook that doubles by small perturbations until it has its size, refined by nearest-neighbour means after each doubling."""
    require(codebook_size_is_positive=codebook_size > 0)
    rng = np.random.default_rng(seed)
    count, total, _ = moments(vectors, column)
    words = (total / count)[None]
    while True:
        last = np.inf
        for k in range(n_iter):
            counts, sums, distance = assigned(vectors, words, column)
            full = counts >= min_data_per_cluster
            words = np.where(full[:, None], sums / np.maximum(counts, 1)[:, None], words)
            if not full.all():  # a codeword that too few vectors are near to stands beside the fullest one
                spare = np.flatnonzero(~full)
                words[spare] = words[np.argmax(counts)] + rng.normal(size=(len(spare), words.shape[1])) * perturb_factor
            if k and full.all() and abs(last - distance) / max(distance, 1e-16) < eps:
                break
            last = distance
        if len(words) == codebook_size:
            counts, _, distance = assigned(vectors, words, column)
            return Codebook(words, distance, counts)
        more = rng.normal(size=words.shape) * perturb_factor
        words = np.concatenate([words - more, words + more])[:codebook_size]


# --- mixtures


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = float("-inf")

    def log_densities(self, v: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        out = np.empty((len(v), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            half = np.linalg.solve(np.linalg.cholesky(c), (v - m).T)
            out[:, k] = np.log(w) - 0.5 * ((half**2).sum(0) + np.linalg.slogdet(2 * np.pi * c)[1])
        return out

    def posteriors(self, x: Column | str) -> Column:
        def run(v: np.ndarray) -> np.ndarray:
            p = self.log_densities(v)
            p = np.exp(p - p.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        return batched(run, x)

    def transform(self, x: Column | str) -> Column:
        """The number of the likeliest component."""
        return batched(lambda v: self.log_densities(v).argmax(1).astype(float), x, returns="double").cast("long")

    def regression(self, x: Column | str) -> Column:
        """The mean of the dimensions behind those given, on the condition of the given ones, by the likeliest component."""

        def run(v: np.ndarray) -> np.ndarray:
            d = v.shape[1]
            part = Mixture(self.weights, self.means[:, :d], self.covariances[:, :d, :d])
            k = part.log_densities(v).argmax(1)
            slope = np.stack([np.linalg.solve(c[:d, :d], c[:d, d:]) for c in self.covariances])
            return self.means[k][:, d:] + np.einsum("nd,nde->ne", v - self.means[k][:, :d], slope[k])

        return batched(run, x)


def covariance_mask(dims: int, var_type: str, block_size: list[int] | None) -> np.ndarray:
    """Which covariances count: all inside a block; for diag those of equal places of blocks of equal size (one block: the diagonal)."""
    sizes = list(block_size or [dims])
    require(blocks_add_up_to_the_dimensions=sum(sizes) == dims and all(b > 0 for b in sizes))
    block = np.repeat(np.arange(len(sizes)), sizes)
    if var_type == "full":
        return (block[:, None] == block).astype(float)
    size = np.repeat(sizes, sizes)
    place = np.concatenate([np.arange(b) for b in sizes])
    return ((size[:, None] == size) & (place[:, None] == place)).astype(float)


def floored(cov: np.ndarray, var_floor: float) -> np.ndarray:
    diagonal = np.arange(cov.shape[-1])
    cov = cov.copy()
    cov[:, diagonal, diagonal] = np.maximum(cov[:, diagonal, diagonal], var_floor)
    return cov


def gmm(
    vectors: DataFrame, n_mixture: int, n_iter: int = 100, eps: float = 1e-5, weight_floor: float = 1e-5, var_floor: float = 1e-6, var_type: str = "diag",
    block_size: list[int] | None = None, ubm: Mixture | None = None, alpha: float = 0, start: Mixture | None = None, seed: int | None = None, column: str = "x",
) -> Mixture:
    """Expectation and maximisation from a codebook (or start, or ubm); alpha draws the means to those of ubm."""
    require(var_type_is_diag_or_full=var_type in ("diag", "full"), alpha_needs_a_ubm=not alpha or ubm is not None)
    book = None
    if start is None and ubm is None:
        book = lbg(vectors, n_mixture, seed=seed, column=column)
    dims = (book.words if book else (start or ubm).means).shape[1]
    mask = covariance_mask(dims, var_type, block_size)
    plain = (mask == np.eye(dims)).all()

    def products(share: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of each component: the weighted sum of outer products, of their diagonals alone where nothing else counts."""
        if plain:
            return share.T @ (v * v)
        return (share.T @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)) if len(v) * dims * dims < 1 << 24 else np.stack([(v * share[:, [k]]).T @ v for k in range(share.shape[1])]).reshape(share.shape[1], -1)

    def spread(sums: np.ndarray) -> np.ndarray:
        return np.stack([np.diag(s) for s in sums]) if plain else sums.reshape(-1, dims, dims)

    if book:  # each cluster's own weight and covariance

        def clusters(v: np.ndarray) -> np.ndarray:
            return products(np.eye(n_mixture)[square_distances(v, book.words).argmin(1)], v).reshape(-1)

        outer = spread(totals(vectors, clusters, column).reshape(n_mixture, -1))
        own = np.maximum(book.counts, 1)[:, None, None]
        start = Mixture(np.maximum(book.counts / book.counts.sum(), weight_floor), book.words, floored((outer / own - book.words[:, :, None] * book.words[:, None, :]) * mask, var_floor))
    model = start or ubm
    last = -np.inf
    for k in range(n_iter):

        def sums(v: np.ndarray, now: Mixture = model) -> np.ndarray:
            p = now.log_densities(v)
            top = p.max(1, keepdims=True)
            likelihood = top[:, 0] + np.log(np.exp(p - top).sum(1))
            share = np.exp(p - likelihood[:, None])
            return np.concatenate([[likelihood.sum(), len(v)], share.sum(0), (share.T @ v).reshape(-1), products(share, v).reshape(-1)])

        got = totals(vectors, sums, column)
        likelihood, count = got[:2]
        size = got[2 : 2 + n_mixture]
        first = got[2 + n_mixture : 2 + n_mixture * (1 + dims)].reshape(n_mixture, dims)
        outer = spread(got[2 + n_mixture * (1 + dims) :].reshape(n_mixture, -1))
        weights = np.maximum(size / count, weight_floor)
        weights /= weights.sum()
        if alpha:
            means = (first + alpha * ubm.weights[:, None] * ubm.means) / (size + alpha * ubm.weights)[:, None]
        else:
            means = first / np.maximum(size, 1e-300)[:, None]
        cross = np.einsum("kd,ke->kde", first, means)
        cov = (outer - cross - cross.transpose(0, 2, 1)) / np.maximum(size, 1e-300)[:, None, None] + np.einsum("kd,ke->kde", means, means)
        model = Mixture(weights, means, floored(cov * mask, var_floor), likelihood / count)
        if k and likelihood - last < eps:
            break
        last = likelihood
    return model


# --- non-negative factors


@dataclass(frozen=True)
class Factors:
    """Rows of the input are activations times components. activations: key, u."""

    components: np.ndarray
    activations: DataFrame
    divergence: float


def nmf(vectors: DataFrame, n_comp: int, beta: float = 0, n_iter: int = 100, eps: float = 1e-5, inner: int = 1, act_norm: bool = False, seed: int = 0, key: str = "id", column: str = "x") -> Factors:
    """Multiplicative updates for the beta divergence. A row's activations depend on that row and the components alone:
    every iteration begins them anew from the same start and repeats the row update, so that nothing but sums is kept between iterations.
    act_norm divides a row's activations by their sum after each update.
    """
    rng = np.random.default_rng(seed)
    count, total, _ = moments(vectors, column)
    h = rng.random((n_comp, len(total))) + 0.1
    power = 1 / (2 - beta) if beta < 1 else 1 / (beta - 1) if beta > 2 else 1.0
    level = float(total.sum() / count / len(total)) / n_comp

    def activations(v: np.ndarray, components: np.ndarray, rounds: int) -> np.ndarray:
        u = np.full((len(v), n_comp), level / components.mean())
        for _ in range(rounds):
            y = u @ components + 1e-16
            u = u * (((v * y ** (beta - 2)) @ components.T) / (y ** (beta - 1) @ components.T)) ** power
            if act_norm:
                u = u / u.sum(axis=1, keepdims=True)
        return u

    def gap(v: np.ndarray, y: np.ndarray) -> float:
        if beta == 0:
            return float(np.sum(v / y - np.log(v / y) - 1))
        if beta == 1:
            return float(np.sum(v * np.log(v / y) - v + y))
        return float(np.sum((v**beta + (beta - 1) * y**beta - beta * v * y ** (beta - 1)) / (beta * (beta - 1))))

    last, divergence, rounds = np.inf, np.inf, 20 * inner
    for _ in range(n_iter):

        def sums(v: np.ndarray, components: np.ndarray = h) -> np.ndarray:
            u = activations(v, components, rounds)
            y = u @ components + 1e-16
            return np.concatenate([[gap(v, y)], (u.T @ (v * y ** (beta - 2))).reshape(-1), (u.T @ y ** (beta - 1)).reshape(-1)])

        got = totals(vectors, sums, column)
        divergence = got[0]
        above, below = got[1:].reshape(2, *h.shape)
        h = h * (above / below) ** power
        if abs(last - divergence) / max(divergence, 1e-16) < eps:
            break
        last = divergence
    return Factors(h, vectors.select(key, batched(lambda v: activations(v, h, rounds), column).alias("u")), divergence)
