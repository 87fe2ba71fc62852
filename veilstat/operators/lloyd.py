"""Federated k-means: a driver loop of one Spark job a round over cached points."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from veilstat.functions.fixed import SCALE
from veilstat.operators import dp, stats
from veilstat.params import Params


def initial_centroids(params: Params, bounds: tuple[float, float] = (-1.0, 1.0), retries: int = 100) -> np.ndarray:
    """Uniform centroids at a distance from each other and the bounds; the distance is halved, and the draw begun again, after `retries` misses in a row."""
    rng, (lo, hi) = np.random.RandomState(params.seed), bounds
    gap = (hi - lo) / 2
    while gap > 0:
        found: list[np.ndarray] = []
        missed = 0
        while missed < retries and len(found) < params.k:
            x = rng.random_sample(params.dim) * (hi - lo - 2 * gap) + lo + gap
            if not found or min(float(((x - f) ** 2).sum()) for f in found) ** 0.5 >= 2 * gap:
                found.append(x)
                missed = 0
            else:
                missed += 1
        if len(found) == params.k:
            return np.array(found)
        gap /= 2
    raise ValueError("no room for the centroids")


def clip(old: np.ndarray, new: np.ndarray, radius: float) -> np.ndarray:
    move = new - old
    norm = np.linalg.norm(move, axis=1, keepdims=True)
    return np.where(norm > radius, old + radius * move / np.where(norm == 0, 1, norm), new)


def fold(x: np.ndarray, lo: float = -1.0, hi: float = 1.0) -> np.ndarray:
    w = hi - lo
    v = np.mod(x - lo, 2 * w)
    return lo + np.where(v > w, 2 * w - v, v)


def update_centroids(old: np.ndarray, totals: np.ndarray, counts: np.ndarray, params: Params, iteration: int) -> np.ndarray:
    """Next centroids from noisy fixed-point totals and counts."""
    sums = totals / SCALE
    if params.method != "none":
        sums = sums + old * counts[:, None]
    new = sums / (counts[:, None] + 1e-9)
    if params.method != "none" and "unclipped" not in params.post:
        new = clip(old, new, params.max_dist(iteration))
    if "fold" in params.post:
        return fold(new)
    return np.clip(new, -1, 1) if "truncate" in params.post else new


@dataclass
class Result:
    """Centroids in fixed point, points left unassigned by the last round, and what each round did."""

    centroids_fixed: np.ndarray
    unassigned: int
    history: list[dict] = field(default_factory=list)

    @property
    def centroids(self) -> np.ndarray:
        return self.centroids_fixed / SCALE

    def centroids_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.centroids)], "cluster int, features array<double>")

    def history_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "iteration int, max_dist double, moved double, unassigned long, bytes long")


def federated_lloyd(points: DataFrame, params: Params, use_masks: bool = True, kernel: str = "numpy", start: np.ndarray | None = None) -> Result:
    """k-means over (client_id, features in [-1, 1]); only masked sums and counts of clients are added up, and noise goes on the sum."""
    points = points.select("client_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        clients = points.select("client_id").distinct().persist()
        c, history, unassigned = initial_centroids(params) if start is None else np.array(start, float), [], 0
        for it in range(params.iters):
            r = params.max_dist(it)
            rows = c.tolist()
            sums = stats.local_sums(points, rows, r if params.method != "none" else None, kernel)
            if params.method != "none":
                sums = sums.persist()
                unassigned = sums.where(sums.cluster == params.k).agg({"n": "sum"}).first()[0] or 0
            local = stats.with_phantoms(sums, clients, rows, params.phantom)
            if params.method != "none":
                local = stats.relative(local, rows)
            if use_masks:
                out = stats.secure_sum(stats.masked(local, params.dim, params.seed, it), params.dim)
                out = stats.unmask(out, stats.mask_sums(clients, params.k, params.dim, params.seed, it), params.dim)
            else:
                out = stats.secure_sum(local, params.dim)
            got = sorted(out.collect(), key=lambda x: x.cluster)  # k rows
            if params.method != "none":
                sums.unpersist()
            counts = np.array([x.n for x in got], np.int64)
            totals = np.array([[x[f"s{i}"] for i in range(params.dim)] for x in got], np.int64)
            totals, counts = dp.add_noise(totals, counts, params, it)
            new = update_centroids(c, totals, counts, params, it)
            history.append({"iteration": it, "max_dist": float(r), "moved": float(np.linalg.norm(new - c)), "unassigned": int(unassigned), "bytes": params.comm_bytes()})
            c = new
        return Result(np.trunc(c * SCALE).astype(np.int64), int(unassigned), history)
    finally:
        points.unpersist()
