"""Parameter grids, seeded runs and their summaries."""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.operators import analytics, metrics
from veilstat.operators.lloyd import federated_lloyd
from veilstat.operators.ortho import ortho_cluster
from veilstat.params import PRESETS, Params
from veilstat.sources.points import shuffle_and_split


def grid(preset: dict) -> Iterator[dict]:
    """Configurations of a preset: without a mechanism eps is 0, without a method alpha is; repeats go."""
    seen = set()
    for method, post, delay, dp, eps, alpha in itertools.product(preset["methods"], preset["posts"], preset["delays"], preset["dps"], preset["eps_budgets"], preset["alphas"]):
        row = (method, post, delay, dp, 0.0 if dp == "none" else float(eps), 0.0 if method == "none" else float(alpha))
        if row not in seen:
            seen.add(row)
            yield dict(zip(("method", "post", "delay", "dp", "eps", "alpha"), row))


def grid_df(spark: SparkSession, name: str) -> DataFrame:
    """The same as a table."""
    kinds = {"method": "string", "post": "string", "delay": "double", "dp": "string", "eps": "double", "alpha": "double"}
    return spark.createDataFrame([tuple(c[k] for k in kinds) for c in grid(PRESETS[name])], ", ".join(f"{k} {v}" for k, v in kinds.items()))


def run_once(points: DataFrame, params: Params, protocol: str = "local", wanted: str | Sequence[str] = ("nicv", "bcss", "empty"), truth=None) -> dict:
    """Split, cluster, evaluate: one result row."""
    began = time.time()
    split = shuffle_and_split(points, [1] * params.num_clients, params.seed, exact=False)
    row = params.as_row() | {"protocol": protocol}
    if protocol == "ortho":
        got = ortho_cluster(split, params)
        row |= got.stats | {"unassigned": 0}
    elif protocol == "local":
        got = federated_lloyd(split, params)
        row |= {"unassigned": got.unassigned, "num_comm_rounds": 2 * params.iters, "comm_size": params.comm_bytes() * params.iters, "max_dist": params.max_dist(params.iters - 1)}
    else:
        raise ValueError(f"unknown protocol {protocol!r}")
    row["elapsed"] = time.time() - began
    return row | metrics.evaluate(points, got.centroids.tolist(), wanted, truth)


def run_grid(points: DataFrame, dataset: str, base: Params, configs: Sequence[dict], seeds: Sequence[int], protocol: str = "local", threads: int = 2, wanted: str | Sequence[str] = "all", truth=None) -> tuple[list[dict], list[dict]]:
    """(rows, failures) of all configurations and seeds; a failure costs its own row and is told, not hidden. `truth`: centroids that runs are matched with."""
    fixed = {k: v for k, v in base.as_row().items() if k not in ("iters", "seed")}

    def one(job: tuple[dict, int]):
        config, seed = job
        try:
            return run_once(points, Params(**fixed | config | {"seed": seed}), protocol, wanted, truth) | {"dataset": dataset}, None
        except Exception as e:
            return None, config | {"seed": seed, "dataset": dataset, "error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, [(c, s) for c in configs for s in seeds]))
    return [r for r, _ in done if r], [f for _, f in done if f]


def summarise(results: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and half width (`<value>_h`) of each value over seeds, in order of the first value."""
    long = results.select(*by, F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(f"`{v}`").cast("double") for v in values]))).alias("metric", "value"))
    ci = analytics.mean_ci(long, [*by, "metric"], "value")
    wide = ci.groupBy(*by).pivot("metric", list(values)).agg(F.first("mean").alias("m"), F.first("half_width").alias("h"))
    return wide.select(*by, *[x for v in values for x in (F.col(f"`{v}_m`").alias(v), F.col(f"`{v}_h`").alias(f"{v}_h"))]).orderBy(F.col(f"`{values[0]}`").asc_nulls_last())


def save_results(results: DataFrame, path: str, protocol: str = "local") -> None:
    """CSV in order of NICV, in a folder for the protocol."""
    name = "variances_ortho" if protocol == "ortho" else "variances"
    nicv = "nicv" if "nicv" in results.columns else metrics.NAMES["nicv"]
    out = results.orderBy(F.col(f"`{nicv}`").asc_nulls_last()) if nicv in results.columns else results
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """All result tables below a folder, with the file each row is from."""
    return spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).csv(path).withColumn("file", F.input_file_name())


def save_failures(spark: SparkSession, failures: Sequence[dict], path: str) -> None:
    """One JSON array, written by Spark to the file system of the results."""
    spark.createDataFrame([(json.dumps(list(failures)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def successes(rows: Sequence[dict]) -> int:
    return sum(not any(isinstance(v, float) and math.isnan(v) for v in r.values()) for r in rows)
