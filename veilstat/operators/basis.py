"""Orthonormal bases: random, PCA and private PCA. Matrices of d by d' live on the driver; rows never do, but for a subsample of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.operators.dp import find_sigma
from veilstat.sources.points import subsample


def canonical(q: np.ndarray) -> np.ndarray:
    """Each column's entry of largest size made positive."""
    at = np.abs(q).argmax(axis=0)
    return q * np.where(q[at, np.arange(q.shape[1])] < 0, -1.0, 1.0)


def orthogonalize_svd(a: np.ndarray) -> np.ndarray:
    u = np.linalg.svd(a, full_matrices=False)[0]
    return u / np.linalg.norm(u, axis=0)


def random_orthogonal_basis(dim: int, d_prime: int, seed: int = 42) -> np.ndarray:
    return canonical(orthogonalize_svd(np.random.RandomState(seed).randn(dim, min(d_prime, dim))))


def column_means(points: DataFrame, dim: int) -> np.ndarray:
    row = points.agg(*[F.avg(F.col("features")[i]) for i in range(dim)]).first()
    return np.array([x or 0.0 for x in row])


def gram(points: DataFrame, dim: int, means: np.ndarray) -> np.ndarray:
    """Centred second moments, summed in batches and then by a distributed aggregation of d x d cells."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim) - means
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim).astype(np.int32)), pa.array(np.tile(np.arange(dim), dim).astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    for r in points.select("features").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def svd_pca_basis(points: DataFrame, dim: int, d_prime: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram(points, dim, column_means(points, dim)))
    return canonical(vectors[:, ::-1][:, :min(d_prime, dim)])


def clipped_gradient(x: np.ndarray, w: np.ndarray, clip_norm: float) -> np.ndarray:
    """Sum over rows of -2 x (x W)^T, each clipped to a Frobenius norm of `clip_norm`."""
    p = x @ w
    norm = 2 * np.linalg.norm(x, axis=1) * np.linalg.norm(p, axis=1)
    return -2 * (x * np.minimum(1, clip_norm / (norm + 1e-8))[:, None]).T @ p


def _summed_gradient(points: DataFrame, means: np.ndarray, w: np.ndarray, clip_norm: float) -> np.ndarray:
    """The same over a distributed batch: one partial matrix of d x d' a task, summed by cell."""
    import pyarrow as pa

    dim, cols = w.shape
    i, j = (pa.array(a.ravel().astype(np.int32)) for a in np.indices(w.shape))

    def run(batches):
        total = np.zeros((dim, cols))
        for b in batches:
            if b.num_rows:
                total += clipped_gradient(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim) - means, w, clip_norm)
        yield pa.RecordBatch.from_arrays([i, j, pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((dim, cols))
    for r in points.select("features").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def dpsgd_pca_basis(points: DataFrame, dim: int, d_prime: int, epsilon: float, delta: float, clip_norm: float, data_fraction: float = 0.1, epochs: int = 10, batch: int = 256, rate: float = 0.05, seed: int = 0,
                    driver_rows: int = 100_000, steps: int = 50) -> np.ndarray:
    """Oja-like private PCA on a subsample of exactly max(batch, rows * data_fraction) rows; gradients of single rows are clipped, and noise is calibrated by Renyi accounting.

    The mean that centres the rows is not private. A subsample of at most `driver_rows` steps through batches on the driver. A larger one stays distributed: each epoch deals it into `steps` batches by a
    seeded hash, each step is one aggregation of d x d' cells, and noise is calibrated for batches of that size.
    """
    n_all = points.count()
    n = min(n_all, max(batch, int(n_all * data_fraction)))
    keyed = points if "point_id" in points.columns else points.withColumn("point_id", F.xxhash64("features"))
    sample = subsample(keyed, n, seed) if n < n_all else keyed
    rng = np.random.default_rng(np.random.SeedSequence([seed, 7]))
    cols, apart = min(d_prime, dim), n > driver_rows
    batch = -(-n // steps) if apart else min(batch, n)
    sigma = find_sigma(epsilon, delta, n, batch, epochs)
    w = orthogonalize_svd(rng.standard_normal((dim, cols)))
    if apart:
        sample = sample.select("point_id", "features").persist()
        means = column_means(sample, dim)
        for epoch in range(epochs):
            at = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "point_id"), F.lit(steps))
            for s in range(steps):
                g = _summed_gradient(sample.where(at == s), means, w, clip_norm) + rng.normal(0, sigma * clip_norm, w.shape)
                w = np.linalg.qr(w - rate * g / batch)[0]
        sample.unpersist()
        return canonical(w)
    x = np.array([r.features for r in sample.select("features", "point_id").orderBy("point_id").collect()])  # driver_rows at most
    x = x - x.mean(axis=0)
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            b = x[order[s:s + batch]]
            g = clipped_gradient(b, w, clip_norm) + rng.normal(0, sigma * clip_norm, w.shape)
            w = np.linalg.qr(w - rate * g / len(b))[0]
    return canonical(w)


def orthogonal_basis(points: DataFrame | None, dim: int, d_prime: int, method: str = "random", seed: int = 42, **options) -> np.ndarray:
    if method == "random":
        return random_orthogonal_basis(dim, d_prime, seed)
    if method == "svd_pca":
        return svd_pca_basis(points, dim, d_prime)
    if method == "dpsgd_pca":
        return dpsgd_pca_basis(points, dim, d_prime, options["epsilon"], options["delta"], options["clip_norm"], options.get("data_fraction", 0.1), seed=seed)
    raise ValueError(f"unknown basis method {method!r}")
