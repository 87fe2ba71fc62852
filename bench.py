"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from veilstat.plans import catalog  # noqa: E402

HEADLINE = [
    "normalize_minmax", "assign_radius", "local_stats", "federated_step", "secure_sum", "variance_metrics", "cluster_means", "clipped_gradient_sum",
    "silhouette", "dunn", "davies_bouldin", "calinski_harabasz", "auc_eps", "best_by_group", "seeds_summary", "private_lloyd", "private_ortho", "svd_pca_basis",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        f = catalog.queries()[name]
        best = None
        for _ in range(2):  # the first run compiles
            t = time.time()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
