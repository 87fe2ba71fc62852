"""Command line: runs a named experiment over point files and writes result tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilstat", description=__doc__)
    p.add_argument("--exp_type", default="test", choices=("test", "timing", "accuracy", "scale", "ablation"))
    p.add_argument("--datasets", nargs="*", default=None, help="names of point files, or of generated sets")
    p.add_argument("--data_folder", default="data")
    p.add_argument("--results_folder", default="submission")
    p.add_argument("--num_runs", type=int, default=100)
    p.add_argument("--workers", type=int, default=4, help="data sets that run at a time; one in the timing experiment")
    p.add_argument("--method", default=None)
    p.add_argument("--alpha", type=float, default=0.8)
    p.add_argument("--post", default=None)
    p.add_argument("--plot", action="store_true", help="also write the points with their nearest true centroid")
    p.add_argument("--protocol", default="local", choices=("local", "ortho"))
    p.add_argument("--d_primes", type=int, nargs="*", default=None)
    p.add_argument("--d_prime", type=int, default=None)
    p.add_argument("--sigma", type=float, nargs="*", default=None)
    p.add_argument("--basis_method", nargs="*", default=["dpsgd_pca"])
    p.add_argument("--basis_epsilon", type=float, default=0.5)
    p.add_argument("--basis_delta", type=float, default=1e-5)
    p.add_argument("--basis_clip_norm", type=float, default=1.0)
    p.add_argument("--basis_data_fraction", type=float, default=0.1)
    return p


def configurations(args: argparse.Namespace) -> list[dict]:
    """Configurations of the parsed options."""
    from veilstat.operators.sweep import grid
    from veilstat.params import PRESETS

    if args.protocol == "ortho":
        primes = args.d_primes or ([args.d_prime] if args.d_prime else [1, 2, 3])
        sigmas = (0.0, 0.1, 0.5, 1.0, 5.0) if args.sigma is None else args.sigma or [0.0]
        shared = {k: getattr(args, k) for k in ("basis_epsilon", "basis_delta", "basis_clip_norm", "basis_data_fraction")}
        return [shared | {"d_prime": d, "sigma": s, "basis_method": b} for b in args.basis_method for d in primes for s in sigmas]
    preset = dict(PRESETS[args.exp_type])
    if args.exp_type in ("test", "timing"):
        preset["alphas"] = (args.alpha,)
        preset["methods"] = (args.method,) if args.method else preset["methods"]
        preset["posts"] = (args.post,) if args.post else preset["posts"]
    return list(grid(preset))


# fixed values: shapes of the generated sets of the timing experiment
TIMING_SHAPES = [(k, d, n) for k in (2, 5) for d in (2, 5) for n in (10_000, 100_000)]


def default_datasets(exp_type: str) -> list[str]:
    """Data sets of an experiment that names none."""
    from veilstat.sources import points as P

    if exp_type == "accuracy":
        return list(P.NUM_CLUSTERS)
    if exp_type == "timing":
        return ["s1", "lsun", *[f"timesynth_{k}_{d}_{n}" for k, d, n in TIMING_SHAPES]]
    return P.scale_names() if exp_type == "scale" else ["s1", "lsun"]


def run_dataset(spark, name: str, args: argparse.Namespace) -> list[dict]:
    """Runs all configurations on a data set, writes its results and gives the failures."""
    from pyspark.sql import functions as F

    from veilstat.operators import metrics, stats
    from veilstat.operators.sweep import run_grid, save_results
    from veilstat.params import Params
    from veilstat.sources import points as P

    generated = name in ("s1", "lsun", "birch2") or name.startswith(("timesynth", "SynthNew"))
    raw = P.synthetic(spark, name).select("point_id", "features") if generated else P.load_txt(spark, f"{args.data_folder}/{name}.txt").withColumn("point_id", F.monotonically_increasing_id())
    dim, n, k = len(raw.first().features), raw.count(), P.known_k(name, P.NUM_CLUSTERS)
    scaled = P.normalize(raw, dim).persist()
    folder, truth, wanted = f"{args.results_folder}/{args.exp_type}/{name}", None, ("nicv", "bcss", "empty_clusters")
    if args.exp_type == "accuracy":
        truth, wanted = metrics.ground_truth(scaled, k).tolist(), "all"
        if args.plot:
            stats.assigned(scaled, truth).select("point_id", "cluster", "features").write.mode("overwrite").parquet(f"{folder}/points")
    threads = 1 if args.exp_type == "timing" else 2  # runs that are timed have the machine to themselves
    rows, bad = run_grid(scaled, name, Params(k=k, dim=dim, data_size=n), configurations(args), range(args.num_runs), args.protocol, threads=threads, wanted=wanted, truth=truth)
    if rows:
        save_results(spark.createDataFrame(rows), folder, args.protocol)
    scaled.unpersist()
    return bad


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import SparkSession

    from veilstat.operators.sweep import save_failures

    spark = SparkSession.builder.appName("veilstat").config("spark.scheduler.mode", "FAIR").getOrCreate()
    names = args.datasets or default_datasets(args.exp_type)

    def one(name: str) -> list[dict]:
        try:
            return run_dataset(spark, name, args)
        except Exception as e:  # a data set that can't be read costs its own runs and is told
            return [{"dataset": name, "error": f"{type(e).__name__}: {e}"}]

    with ThreadPoolExecutor(1 if args.exp_type == "timing" else min(args.workers, len(names))) as pool:
        failures = [f for bad in pool.map(one, names) for f in bad]
    if failures:
        save_failures(spark, failures, f"{args.results_folder}/failed.json")
    return int(bool(failures))


if __name__ == "__main__":
    raise SystemExit(main())
