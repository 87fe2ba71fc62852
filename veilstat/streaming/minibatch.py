"""An extension: running cluster statistics over a stream of points. The batch protocol doesn't need it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.fixed import to_fixed
from veilstat.operators.stats import assigned


def windowed_stats(points: DataFrame, centroids: Sequence[Sequence[float]], time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and fixed-point sums by event-time window, client and cluster; rows later than the watermark go."""
    d = len(centroids[0])
    rows = assigned(points.withWatermark(time, late), centroids)
    return rows.groupBy(F.window(time, window).alias("window"), "client_id", "cluster").agg(F.count("*").alias("n"), *[F.sum(to_fixed(F.col("features")[i])).alias(f"s{i}") for i in range(d)])
