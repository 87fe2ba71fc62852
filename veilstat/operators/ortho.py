"""Clustering by the signs of projections on an orthonormal basis."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions import vectors as V
from veilstat.functions.fixed import SCALE
from veilstat.operators.basis import orthogonal_basis, random_orthogonal_basis
from veilstat.params import Params


def ortho_assign(points: DataFrame, basis: np.ndarray) -> DataFrame:
    return points.withColumn("label", V.sign_label(V.project(F.col("features"), basis.tolist())))


def cluster_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("count"))


def cluster_centers(labelled: DataFrame, dim: int) -> DataFrame:
    """(label, count, center) of occupied labels, in order of label."""
    return labelled.groupBy("label").agg(F.count("*").alias("count"), F.array(*[F.avg(F.col("features")[i]) for i in range(dim)]).alias("center")).orderBy("label")


def quadrant_stats(counts: DataFrame) -> DataFrame:
    c = F.col("count")
    return counts.agg(F.min(c).alias("count_min"), F.max(c).alias("count_max"), F.avg(c).alias("count_mean"), F.stddev_pop(c).alias("count_std"), F.count("*").alias("occupied_quadrants"))


def basis_occupancy(points: DataFrame, bases: Sequence[tuple[int, int, np.ndarray]]) -> DataFrame:
    """d_prime, seed, num_clusters, num_occupied and sizes of occupied clusters for each (d_prime, seed, basis), all from one scan and one small shuffle."""
    runs = F.array(*[F.struct(F.lit(d).alias("d_prime"), F.lit(s).alias("seed"), V.sign_label(V.project(F.col("features"), q.tolist())).alias("label")) for d, s, q in bases])
    sizes = points.select(F.explode(runs).alias("r")).groupBy("r.d_prime", "r.seed", "r.label").agg(F.count("*").alias("n"))
    return sizes.groupBy("d_prime", "seed").agg(
        F.pow(F.lit(2.0), F.first("d_prime")).cast("int").alias("num_clusters"), F.count("*").alias("num_occupied"),
        F.min("n").alias("cluster_size_min"), F.max("n").alias("cluster_size_max"), F.stddev_pop("n").alias("cluster_size_std"))


def basis_benchmark(points: DataFrame, dim: int, d_primes: Sequence[int], seeds: Sequence[int]) -> list[dict]:
    """A row for each d' and seed of random bases, with the time of that run alone."""
    out = []
    for d in d_primes:
        for s in seeds:
            began = time.time()
            row = basis_occupancy(points, [(d, s, random_orthogonal_basis(dim, d, s))]).first()
            out.append(row.asDict() | {"elapsed": time.time() - began})
    return out


def benchmark_summary(rows: DataFrame, last: int) -> DataFrame:
    """Means by d' over the last `last` seeds."""
    newest = Window.partitionBy("d_prime").orderBy(F.col("seed").desc())
    return rows.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= last).groupBy("d_prime").agg(
        F.first("num_clusters").alias("num_clusters"), F.avg("num_occupied").alias("num_occupied"), F.avg("elapsed").alias("elapsed"))


@dataclass
class OrthoResult:
    centroids_fixed: np.ndarray
    labels: np.ndarray
    basis: np.ndarray
    stats: dict

    @property
    def centroids(self) -> np.ndarray:
        return self.centroids_fixed / SCALE


def noisy_centers(centers: np.ndarray, counts: np.ndarray, sigma: float, seed: int = 0, noisy_counts: bool = False) -> np.ndarray:
    """Means from noisy sums; counts are exact, so this alone is no private release, unless `noisy_counts`."""
    rng = np.random.default_rng(np.random.SeedSequence([seed, 11]))
    sums = centers * counts[:, None] + rng.normal(0, sigma, centers.shape)
    n = np.maximum(1, counts + np.round(rng.normal(0, sigma, len(counts)))) if noisy_counts else counts
    return sums / n[:, None]


def ortho_cluster(points: DataFrame, params: Params, noisy_counts: bool = False) -> OrthoResult:
    q = orthogonal_basis(points, params.dim, params.d_prime, params.basis_method, params.seed, epsilon=params.basis_epsilon, delta=params.basis_delta, clip_norm=params.basis_clip_norm, data_fraction=params.basis_data_fraction)
    rows = cluster_centers(ortho_assign(points, q), params.dim).collect()  # 2^d' rows at most
    centers, counts = np.array([r.center for r in rows]), np.array([r["count"] for r in rows])
    if params.sigma > 0:
        centers = noisy_centers(centers, counts, params.sigma, params.seed, noisy_counts)
    stats = {"count_min": int(counts.min()), "count_max": int(counts.max()), "count_mean": float(counts.mean()), "count_std": float(counts.std()), "occupied_quadrants": len(counts), "d_prime": q.shape[1]}
    return OrthoResult(np.trunc(centers * SCALE).astype(np.int64), np.array([r.label for r in rows]), q, stats)
