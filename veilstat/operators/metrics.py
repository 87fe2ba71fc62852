"""Clustering quality on nearest-centroid assignments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from veilstat.functions import vectors as V
from veilstat.operators.hungarian import assignment
from veilstat.operators.stats import assigned

BLOCK_ROWS = 2048  # points of a block of the pairwise metrics, which take n^2 distances

# fixed values: names of metrics, as asked for and as result tables have them
NAMES = {
    "nicv": "Normalized Intra-cluster Variance (NICV)", "bcss": "Between-Cluster Sum of Squares (BCSS)", "empty_clusters": "Empty Clusters", "mse": "Mean Squared Error",
    "silhouette": "Silhouette Score", "davies_bouldin": "Davies-Bouldin Index", "calinski_harabasz": "Calinski-Harabasz Index", "dunn_index": "Dunn Index",
}
SHORT = {"empty": "empty_clusters", "calinski": "calinski_harabasz", "dunn": "dunn_index"}


def one_pass(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """One row: wcss, nicv, bcss, empty_clusters. Points are read once."""
    k, d = len(centroids), len(centroids[0])
    a = assigned(points, centroids)
    by = a.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("min_d2").alias("w"), *[F.sum(F.col("features")[i]).alias(f"s{i}") for i in range(d)])
    whole = by.agg(F.sum("n").alias("n"), F.sum("w").alias("wcss"), F.count("*").alias("full"), F.collect_list(F.struct("cluster", "n")).alias("counts"), *[(F.sum(f"s{i}") / F.sum("n")).alias(f"m{i}") for i in range(d)])
    mean = F.array(*[F.col(f"m{i}") for i in range(d)])
    c = F.array(*[V.vector(row) for row in centroids])
    bcss = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x["n"] * V.sq_distance(F.get(c, x["cluster"]), mean))
    return whole.select("wcss", (F.col("wcss") / F.col("n")).alias("nicv"), bcss.alias("bcss"), (F.lit(k) - F.col("full")).cast("int").alias("empty_clusters"))


def cluster_means(labelled: DataFrame, dim: int, label: str = "cluster") -> DataFrame:
    return labelled.groupBy(F.col(label).alias("cluster")).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("features")[i]) for i in range(dim)]).alias("mean"))


def davies_bouldin(labelled: DataFrame, dim: int) -> DataFrame:
    """One row: the mean over clusters of the worst (S_i + S_j) / M_ij; infinite with fewer than two clusters."""
    means = F.broadcast(cluster_means(labelled, dim))  # a row for each cluster
    spread = labelled.join(means, "cluster").groupBy("cluster").agg(F.avg(F.sqrt(V.sq_distance(F.col("features"), F.col("mean")))).alias("s"), F.first("mean").alias("mean"))
    a, b = spread.alias("a"), spread.alias("b")
    worst = a.join(F.broadcast(b), F.col("a.cluster") != F.col("b.cluster")).groupBy("a.cluster").agg(
        F.max(F.try_divide(F.col("a.s") + F.col("b.s"), F.sqrt(V.sq_distance(F.col("a.mean"), F.col("b.mean"))))).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(float("inf"))).alias("davies_bouldin"))


def calinski_harabasz(labelled: DataFrame, dim: int) -> DataFrame:
    """One row: [tr B / (k - 1)] / [tr W / (n - k)]; 0 with fewer than two clusters."""
    f = F.col("features")
    by = labelled.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f[i]).alias(f"s{i}") for i in range(dim)], F.sum(V.dot(f, f)).alias("q"))
    whole = by.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0)) / F.col("n")).alias("between"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)])
    mean2 = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0)) / F.col("n")
    b, w = F.col("between") - mean2, F.col("q") - F.col("between")
    return whole.select(F.coalesce(F.when(F.col("k") < 2, 0.0).otherwise(F.try_divide(b / (F.col("k") - 1), w / (F.col("n") - F.col("k")))), F.lit(0.0)).alias("calinski_harabasz"))


def _block_pairs(labelled: DataFrame, kernel, schema: str, block_rows: int) -> DataFrame:
    """kernel(x, lx, idx, y, ly, idy, same) over each pair of blocks of points, in tasks of their own: no task holds more than two blocks of about `block_rows`."""
    spark = labelled.sparkSession
    n = max(1, -(-labelled.count() // block_rows))
    rows = labelled.select("features", "cluster", F.monotonically_increasing_id().alias("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select("features", "cluster", "id", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def run(t: pa.Table) -> pa.Table:
        x, label, ident, block = np.array(t.column("features").to_pylist(), float), *(t.column(c).to_numpy() for c in ("cluster", "id", "block"))
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        a, b = block == one, block == two
        return pa.Table.from_batches(list(kernel(x[a], label[a], ident[a], x[b], label[b], ident[b], one == two)), schema=pa_schema)

    pa_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return rows.groupBy("one", "two").applyInArrow(run, schema)


def _distances(x: np.ndarray, y: np.ndarray):
    """(first row, distances of some rows of x to all of y)."""
    step = max(1, 4_000_000 // max(1, y.size))
    for s in range(0, len(x), step):
        yield s, np.sqrt(((x[s:s + step, None, :] - y[None]) ** 2).sum(axis=2))


def silhouette(labelled: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: mean Euclidean silhouette, 0 for single points; -1 unless 2 <= clusters <= n - 1. Distances are summed by pairs of blocks of points, so any number of points will do."""
    sizes = {r.cluster: r.n for r in labelled.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    spark, ids = labelled.sparkSession, sorted(sizes)
    n = sum(sizes.values())
    if not 2 <= len(ids) <= n - 1:
        return spark.range(1).select(F.lit(-1.0).alias("silhouette"))
    known = np.array(ids)

    def kernel(x, lx, ix, y, ly, iy, same):
        for p, lp, ip, q, lq in [(x, lx, ix, y, ly)] + ([] if same else [(y, ly, iy, x, lx)]):
            masks = [lq == c for c in known]
            for s, d in _distances(p, q):
                sums = np.stack([d[:, m].sum(axis=1) for m in masks], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ip[s:s + len(d)]), pa.array(lp[s:s + len(d)].astype(np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "cluster", "sums"])

    parts = _block_pairs(labelled, kernel, "id long, cluster int, sums array<double>", block_rows)
    by = parts.groupBy("id", "cluster").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(len(ids))])
    size = F.create_map(*[F.lit(v) for c in ids for v in (c, sizes[c])])
    own = size[F.col("cluster")]
    a = F.get(F.array(*[f"s{j}" for j in range(len(ids))]), F.array_position(F.array(*map(F.lit, ids)), F.col("cluster")).cast("int") - 1) / F.greatest(own - 1, F.lit(1))
    b = F.least(*[F.when(F.col("cluster") != c, F.col(f"s{j}") / sizes[c]).otherwise(float("inf")) for j, c in enumerate(ids)])
    s = F.when(own > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    return by.agg(F.avg(s).alias("silhouette"))


def dunn(labelled: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: least distance between clusters over the largest diameter; null where that isn't defined. Pairs of blocks give their own least and largest."""
    def kernel(x, lx, ix, y, ly, iy, same):
        apart, wide = np.inf, 0.0
        for s, d in _distances(x, y):
            equal = lx[s:s + len(d), None] == ly[None]
            apart, wide = min(apart, np.where(equal, np.inf, d).min(initial=np.inf)), max(wide, np.where(equal, d, 0).max(initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array([float(apart)]), pa.array([float(wide)])], names=["apart", "wide"])

    got = _block_pairs(labelled, kernel, "apart double, wide double", block_rows).agg(F.min("apart").alias("a"), F.max("wide").alias("w"))
    return got.select(F.when((F.col("a") < float("inf")) & (F.col("w") > 0), F.try_divide(F.col("a"), F.col("w"))).alias("dunn"))


def matched_distance(centroids: np.ndarray, truth: np.ndarray, squared: bool = False) -> float:
    """Mean distance of optimally matched centroids; the unsquared one is what result tables call MSE."""
    d = np.sqrt(((centroids[:, None] - truth[None]) ** 2).sum(axis=2))
    at = assignment(d)
    v = d[np.arange(len(d)), at]
    return float((v**2).mean() if squared else v.mean())


def evaluate(points: DataFrame, centroids: Sequence[Sequence[float]], metrics: str | Sequence[str] = "all", truth: Sequence[Sequence[float]] | None = None) -> dict[str, float]:
    """Metrics by display name; unknown names are skipped, those of several clusters have defaults where fewer than two are occupied."""
    want = list(NAMES) if metrics == "all" else [metrics] if isinstance(metrics, str) else list(metrics)
    want = [SHORT.get(w, w) for w in want]
    centroids, d, out = [list(map(float, c)) for c in centroids], len(centroids[0]), {}
    base = one_pass(points, centroids).first() if {"nicv", "bcss", "empty_clusters", "wcss"} & {*want} else None
    for name, field in (("nicv", "nicv"), ("bcss", "bcss"), ("empty_clusters", "empty_clusters")):
        if name in want:
            out[NAMES[name]] = base[field]
    if "wcss" in want:
        out["WCSS"] = base.wcss
    labelled = assigned(points, centroids).select("features", "cluster")
    if "silhouette" in want:
        out[NAMES["silhouette"]] = silhouette(labelled).first()[0]
    if "davies_bouldin" in want:
        out[NAMES["davies_bouldin"]] = davies_bouldin(labelled, d).first()[0]
    if "calinski_harabasz" in want:
        out[NAMES["calinski_harabasz"]] = calinski_harabasz(labelled, d).first()[0]
    if "dunn_index" in want:
        v = dunn(labelled).first()[0]
        out[NAMES["dunn_index"]] = math.nan if v is None else v
    if "mse" in want and truth is not None and (metrics != "all" or len(truth) == len(centroids)):
        out[NAMES["mse"]] = matched_distance(np.array(centroids), np.array(truth))
    return out


def ground_truth(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """Seeded k-means of the ML library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed).fit(points.select(array_to_vector("features").alias("features")))
    return np.array(model.clusterCenters())
