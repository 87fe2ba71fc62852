"""Per-client cluster statistics and their secure sum."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions import vectors as V
from veilstat.functions.fixed import MOD, SCALE, to_fixed

BLOCK = 1024


def assigned(points: DataFrame, centroids: Sequence[Sequence[float]], radius: float | None = None) -> DataFrame:
    """Adds cluster and min_d2, in Catalyst expressions."""
    d2 = V.sq_distances(F.col("features"), centroids)
    return points.withColumn("_d2", d2).withColumn("cluster", V.assign(F.col("_d2"), radius)).withColumn("min_d2", F.array_min("_d2")).drop("_d2")


def local_sums(points: DataFrame, centroids: Sequence[Sequence[float]], radius: float | None = None, kernel: str = "numpy") -> DataFrame:
    """(client_id, cluster, n, s0..): counts and fixed-point sums; cluster k holds the unassigned.

    Sums are of integers, so their order doesn't matter. The NumPy kernel sends one partial row for each batch, client and cluster to the shuffle; "sql"
    is the same in Catalyst expressions.
    """
    c = np.array(centroids, np.float64)
    k, d = c.shape
    names = [f"s{i}" for i in range(d)]
    if kernel == "sql":
        rows = assigned(points, centroids, radius)
        return rows.groupBy("client_id", "cluster").agg(F.count("*").alias("n"), *[F.sum(to_fixed(F.col("features")[i])).alias(names[i]) for i in range(d)])
    if kernel != "numpy":
        raise ValueError(f"unknown kernel {kernel!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            label = np.empty(b.num_rows, np.int64)
            for s in range(0, b.num_rows, BLOCK):
                d2 = ((x[s:s + BLOCK, None, :] - c[None]) ** 2).sum(axis=2)
                label[s:s + BLOCK] = d2.argmin(axis=1)
                if radius is not None:
                    label[s:s + BLOCK][d2.min(axis=1) > radius * radius] = k
            client = b.column(0).to_numpy()
            ids, inv = np.unique(client * (k + 1) + label, return_inverse=True)
            n, sums = np.bincount(inv, minlength=len(ids)), np.zeros((len(ids), d), np.int64)
            np.add.at(sums, inv, np.trunc(x * SCALE).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((ids // (k + 1)).astype(np.int32)), pa.array((ids % (k + 1)).astype(np.int32)), pa.array(n.astype(np.int64)), *[pa.array(sums[:, i]) for i in range(d)]], names=["client_id", "cluster", "n", *names])

    part = points.select("client_id", "features").mapInArrow(run, "client_id int, cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    return part.groupBy("client_id", "cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def with_phantoms(sums: DataFrame, clients: DataFrame, centroids: Sequence[Sequence[float]], phantom: bool = True) -> DataFrame:
    """The full grid of clients and clusters; an empty local cluster counts as one point at the centroid, or as none without `phantom`. Unassigned points go."""
    k, d = len(centroids), len(centroids[0])
    grid = clients.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    c = F.array(*[F.array(*[F.lit(int(v * SCALE)).cast("long") for v in row]) for row in centroids])
    fill = lambda i: F.get(F.get(c, F.col("cluster")), F.lit(i)) if phantom else F.lit(0).cast("long")
    out = grid.join(sums, ["client_id", "cluster"], "left")
    return out.select("client_id", "cluster", F.coalesce("n", F.lit(int(phantom)).cast("long")).alias("n"), *[F.coalesce(f"s{i}", fill(i)).alias(f"s{i}") for i in range(d)])


def relative(stats: DataFrame, centroids: Sequence[Sequence[float]], sign: int = -1) -> DataFrame:
    """Totals relative to the centroids (sign -1), or back (sign 1), in fixed point."""
    d = len(centroids[0])
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centroids])
    return stats.select("client_id", "cluster", "n", *[to_fixed(F.col(f"s{i}") / float(SCALE) + sign * F.get(F.get(c, F.col("cluster")), F.lit(i)) * F.col("n")).alias(f"s{i}") for i in range(d)])


def mask_of(seed: int, iteration: int, client: Column, cluster: Column, place: int) -> Column:
    """Uniform in the ring, from a digest of its place. For tests of the protocol; a deployment needs a keyed generator."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(iteration)), client.cast("string"), cluster.cast("string"), F.lit(str(place)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def masked(stats: DataFrame, dim: int, seed: int, iteration: int) -> DataFrame:
    """What leaves the clients: each number plus its mask, in the ring."""
    cols = ["n", *[f"s{i}" for i in range(dim)]]
    return stats.select("client_id", "cluster", *[F.pmod(F.col(c) + mask_of(seed, iteration, F.col("client_id"), F.col("cluster"), j), F.lit(MOD)).alias(c) for j, c in enumerate(cols)])


def mask_sums(clients: DataFrame, k: int, dim: int, seed: int, iteration: int) -> DataFrame:
    """(cluster, m_n, m_s0..): what all clients' masks add up to."""
    grid = clients.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    cols = ["n", *[f"s{i}" for i in range(dim)]]
    rows = grid.select("cluster", *[mask_of(seed, iteration, F.col("client_id"), F.col("cluster"), j).alias(f"m_{c}") for j, c in enumerate(cols)])
    return rows.groupBy("cluster").agg(*[F.pmod(F.sum(f"m_{c}"), F.lit(MOD)).alias(f"m_{c}") for c in cols])


def secure_sum(stats: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, s0..) over clients."""
    cols = ["n", *[f"s{i}" for i in range(dim)]]
    return stats.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in cols])


def unmask(sums: DataFrame, masks: DataFrame, dim: int) -> DataFrame:
    """Sums less the masks' sums, as the ring's residues around 0."""
    cols = ["n", *[f"s{i}" for i in range(dim)]]

    def lift(c: str) -> Column:
        v = F.pmod(F.col(c) - F.col(f"m_{c}"), F.lit(MOD))
        return F.when(v >= MOD // 2, v - MOD).otherwise(v).alias(c)

    return sums.join(masks, "cluster").select("cluster", *[lift(c) for c in cols])
