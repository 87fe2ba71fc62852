"""Point sets: readers, generators, normalisation and the split among clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_columns(df: DataFrame, columns: Sequence[str], point_id: Column, client_id: Column | None = None) -> DataFrame:
    """(point_id, client_id, features) of any table."""
    client = (client_id if client_id is not None else F.lit(0)).cast("int")
    return df.select(point_id.cast("bigint").alias("point_id"), client.alias("client_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def parse_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """features of lines of numbers apart by white space; lines with the letter x are headers."""
    rows = lines.where(~F.col(column).contains("x"))
    return rows.select(F.transform(F.split(F.trim(column), r"\s+"), lambda v: v.cast("double")).alias("features"))


def load_txt(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.read.text(path))


def format_points(points: DataFrame, decimals: int = 6) -> DataFrame:
    return points.select(F.array_join(F.transform("features", lambda v: F.format_string(f"%.{decimals}f", v)), " ").alias("value"))


def save_dataset(points: DataFrame, path: str) -> None:
    """Six decimals, features only, one point a line."""
    format_points(points).write.mode("overwrite").text(path)


def ingest_delimited(lines: DataFrame, picks: Sequence[int], least_fields: int, delimiter: str = r"\s+", column: str = "value") -> DataFrame:
    """features from chosen fields of delimited lines; short and unparsable lines go."""
    parts = F.split(F.trim(column), delimiter)
    rows = lines.where(F.size(parts) >= least_fields).select(F.array(*[F.get(parts, F.lit(i)).try_cast("double") for i in picks]).alias("features"))
    return rows.where(F.forall("features", lambda v: v.isNotNull()))


def load_yeast(spark: SparkSession, path: str) -> DataFrame:
    return ingest_delimited(spark.read.text(path), range(1, 9), 9)


def load_adult(spark: SparkSession, path: str) -> DataFrame:
    return ingest_delimited(spark.read.text(path), (0, 2, 4, 10, 11, 12), 15, r"\s*,\s*")


def column_ranges(points: DataFrame, dim: int) -> DataFrame:
    """One row: lo and hi arrays."""
    f = F.col("features")
    return points.agg(F.array(*[F.min(f[i]) for i in range(dim)]).alias("lo"), F.array(*[F.max(f[i]) for i in range(dim)]).alias("hi"))


def normalize(points: DataFrame, dim: int, fixed: bool = False) -> DataFrame:
    """Min-max to [-1, 1] by column, a constant column to 0; `fixed` gives fixed-point BIGINTs."""
    ranges = F.broadcast(column_ranges(points, dim))  # one row
    scaled = F.transform("features", lambda x, i: F.when(F.get("hi", i) == F.get("lo", i), 0.0).otherwise(
        F.try_divide(x - F.get("lo", i), F.get("hi", i) - F.get("lo", i)) * 2 - 1))
    if fixed:
        scaled = F.transform(scaled, lambda x: (x * 65536.0).cast("bigint"))
    return points.crossJoin(ranges).withColumn("features", scaled).drop("lo", "hi")


def client_sizes(n: int, proportions: Sequence[float]) -> list[int]:
    """Points of each client; the last one gets the remainder."""
    whole = sum(proportions)
    sizes = [int(p / whole * n) for p in proportions]
    return [*sizes[:-1], n - sum(sizes[:-1])]


def shuffle_key(seed: int, point_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(point_id.cast("string"), F.lit(""))))


EDGE_ROWS, DIGITS = 100_000, 4  # rows that are sorted to find a cut, hexadecimal digits of a key that are counted at once (65,536 groups)


def key_at(points: DataFrame, rank: int, seed: int) -> tuple[str, int | None]:
    """(key, point_id) of the row of this rank, from 1, in the seeded order: counts by longer and longer prefixes of the key narrow it down, so no row but those of a last small range is moved."""
    keyed, prefix = points.select(shuffle_key(seed, F.col("point_id")).alias("key"), "point_id"), ""
    while True:
        inside = keyed.where(F.col("key").startswith(prefix)) if prefix else keyed
        counts = inside.groupBy(F.substring("key", 1, len(prefix) + DIGITS).alias("p")).count().orderBy("p").collect()  # 65,536 rows at most
        for r in counts:
            if rank <= r["count"]:
                break
            rank -= r["count"]
        prefix = r.p
        if r["count"] <= EDGE_ROWS or len(prefix) == 32:
            break
    row = keyed.where(F.col("key").startswith(prefix)).orderBy("key", "point_id").offset(rank - 1).limit(1).first()
    return row.key, row.point_id


def beyond(seed: int, at: tuple[str, int | None]) -> Column:
    """Whether a row comes after the one `at` in the seeded order."""
    key, point_id = shuffle_key(seed, F.col("point_id")), F.col("point_id")
    return (key > at[0]) | ((key == at[0]) & F.coalesce(point_id > F.lit(at[1]), F.lit(False)))


def subsample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n rows in a seeded order, found by a filter; repeated point_ids stay together, so that n is exact where they are unique."""
    if n < 1:
        return points.limit(0)
    return points.where(~beyond(seed, key_at(points, n, seed))) if n < points.count() else points


def shuffle_and_split(points: DataFrame, proportions: Sequence[float], seed: int = 1337, exact: bool = True) -> DataFrame:
    """client_id by a seeded order, without moving rows. Exact sizes (of unique point_ids) compare keys with those at the cuts; without `exact` clients are hash ranges of near those sizes."""
    out = F.lit(0)
    if not exact:
        whole, u = sum(proportions), F.conv(F.substring(shuffle_key(seed, F.col("point_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        for i in range(len(proportions) - 1):
            out = out + (u >= sum(proportions[:i + 1]) / whole).cast("int")
        return points.withColumn("client_id", out)
    n, at = points.count(), 0
    for size in client_sizes(n, proportions)[:-1]:
        at += size
        if at < n:
            out = out + (beyond(seed, key_at(points, at, seed)).cast("int") if at else F.lit(1))
    return points.withColumn("client_id", out)


def blobs(spark: SparkSession, n: int, centers: Sequence[Sequence[float]], std: float, seed: int = 42) -> DataFrame:
    """Gaussian blobs around `centers`, dealt in turn."""
    k, d = len(centers), len(centers[0])
    rows = spark.range(n).withColumn("label", (F.col("id") % k).cast("int"))
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centers])
    return rows.select(F.col("id").alias("point_id"), "label", F.array(*[F.get(F.get(c, F.col("label")), F.lit(j)) + F.randn(seed + j) * std for j in range(d)]).alias("features"))


def random_centers(k: int, d: int, seed: int, low: float = -10, high: float = 10) -> list[list[float]]:
    import numpy as np

    return np.random.RandomState(seed).uniform(low, high, (k, d)).tolist()


def synthetic(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    """s1, birch2, lsun, timesynth_k_d_n, SynthNew_k_d_replicate, or blobs for other names."""
    parts = name.split("_")
    if name == "s1":
        return blobs(spark, 5000, random_centers(15, 2, seed), 1.5, seed)
    if name == "birch2":
        return blobs(spark, 100_000, random_centers(100, 2, seed), 0.5, seed)
    if name == "lsun":
        # fixed values: three rectangles as (x, y, width, height)
        boxes = [(0.0, 0.0, 2.0, 1.0), (0.0, 2.0, 1.0, 3.0), (3.0, 3.0, 2.0, 2.0)]
        b = F.array(*[F.array(*[F.lit(v) for v in box]) for box in boxes])
        rows = spark.range(1500).withColumn("label", (F.col("id") / 500).cast("int"))
        at = lambda i: F.get(F.get(b, F.col("label")), F.lit(i))
        return rows.select(F.col("id").alias("point_id"), "label", F.array(at(0) + F.rand(seed) * at(2), at(1) + F.rand(seed + 1) * at(3)).alias("features"))
    if name.startswith("timesynth") and len(parts) == 4:
        k, d, n = map(int, parts[1:])
        return blobs(spark, n, random_centers(k, d, seed), 1.0, seed)
    if name.startswith("SynthNew") and len(parts) == 4:
        k, d, r = map(int, parts[1:])
        return scale_set(spark, k, d, seed=seed, replicate=r)
    return blobs(spark, 1000, random_centers(3, 2, seed), 1.0, seed)


# fixed values: clusters, dimensions and replicates of the generated scale sets
SCALE_ROWS, SCALE_CLUSTERS, SCALE_DIMS, SCALE_REPLICATES = 10_000, (2, 4, 8, 16, 32), (2, 4, 8, 16, 32, 64, 128, 256, 512), 3
SCALE_SEPARATION, SCALE_OUTLIERS = (0.16, 0.26), 100


def proportional_sizes(n: int, k: int, outliers: int = 0) -> list[int]:
    """Sizes in proportion 1:2:...:k, rounded, the last one taking what is left of n; each then gives up its share of the outliers."""
    whole = k * (k + 1) / 2
    sizes = [round(i / whole * n) for i in range(1, k + 1)]
    sizes[-1] += n - sum(sizes)
    return [s - round(outliers * (s / n)) for s in sizes]


def scale_names() -> list[str]:
    """Names of the scale sets: SynthNew_k_d_replicate."""
    return [f"SynthNew_{k}_{d}_{r}" for k in SCALE_CLUSTERS for d in SCALE_DIMS for r in range(1, SCALE_REPLICATES + 1)]


def scale_set(spark: SparkSession, k: int, d: int, n: int = SCALE_ROWS, outliers: int | None = None, separation: float | None = None, seed: int = 1, replicate: int = 1) -> DataFrame:
    """Clusters of growing sizes with uniform outliers (label k).

    What isn't given is drawn by k, d and seed: 0 to 100 outliers and a separation from [0.16, 0.26], which the replicates share; each replicate has centres and noise of its own.
    """
    import numpy as np

    draw = np.random.RandomState([seed, k, d])
    drawn, apart = int(draw.randint(0, SCALE_OUTLIERS + 1)), float(draw.uniform(*SCALE_SEPARATION))
    outliers, separation = drawn if outliers is None else outliers, apart if separation is None else separation
    own = seed + 10_000 * (replicate - 1)
    centers, sizes = random_centers(k, d, own, -1, 1), proportional_sizes(n, k, outliers)
    ends = [sum(sizes[:i + 1]) for i in range(k)]
    label = F.lit(0)
    for e in ends:
        label = label + (F.col("id") >= e).cast("int")
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centers])
    std = (1 - separation) / (2 * k ** (1 / d))
    rows = spark.range(sum(sizes) + outliers).withColumn("label", label)
    noise = lambda j: F.when(F.col("label") < k, F.get(F.get(c, F.col("label")), F.lit(j)) + F.randn(own + j) * std).otherwise(F.rand(own + 1000 + j) * 4 - 2)
    return rows.select(F.col("id").alias("point_id"), "label", F.array(*[noise(j) for j in range(d)]).alias("features"))


def parse_names(df: DataFrame, column: str = "dataset") -> DataFrame:
    """k, d and n that a data set's name tells; null where it doesn't."""
    c = F.col(column)
    num = lambda pattern, group: F.expr(f"try_cast(nullif(regexp_extract({column}, '{pattern}', {group}), '') AS INT)")
    k = F.when(c.startswith("timesynth"), num("^timesynth_([0-9]+)_", 1)).when(F.lower(c).contains("synth"), num("^[^_]*_([0-9]+)_", 1)).when(c.startswith("g2-"), 2)
    d = F.when(F.lower(c).contains("synth"), num("^[^_]*_[0-9]+_([0-9]+)_", 1)).when(c.startswith("g2-"), num("^g2-([0-9]+)-", 1)).when(c.startswith("dim"), num("^dim([0-9]+)", 1))
    n = F.when(c.startswith("timesynth"), num("_([0-9]+)$", 1))
    return df.select(column, k.alias("k"), d.alias("d"), n.alias("n"))


def known_k(name: str, table: dict[str, int]) -> int:
    """Clusters of a data set: from its name if that says so, else from `table`."""
    parts = name.split("_")
    if "synth" in name.lower() and len(parts) > 1:
        return int(parts[1])
    if name not in table:
        raise KeyError(f"no number of clusters for {name}")
    return table[name]


#: fixed values: clusters of the usual data sets
NUM_CLUSTERS = {"iris": 3, "s1": 15, "birch2": 100, "house": 3, "adult": 3, "lsun": 3, "wine": 3, "yeast": 10, "breast": 2, "mnist": 10}
