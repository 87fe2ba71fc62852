"""Registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat import params
from veilstat.functions import fixed, vectors as V
from veilstat.operators import analytics as A
from veilstat.operators import basis, metrics, ortho, stats, sweep
from veilstat.operators.lloyd import federated_lloyd
from veilstat.params import PRESETS, Params
from veilstat.sources import points as P

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CENTROIDS = [[-0.5, -0.5, -0.5, 0.5], [0.5, -0.25, 0.5, -0.5], [0.0, 0.25, -0.25, 0.0], [0.5, 0.5, 0.25, 0.25]]
RADIUS = 0.9
FAR = 0.05  # so small that local clusters are empty
BASIS = [[0.5, 0.5], [0.5, -0.5], [0.5, 0.5], [0.5, -0.5]]
D, K = 4, 4

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_columns(table(spark, sf_dir, "lineitem"), COLUMNS, F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_orderkey") % 2)


def scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalize(raw_points(spark, sf_dir), D)


def wide(df: DataFrame, column: str, names: str, *keep: str, n: int = D, to_fixed: bool = True) -> DataFrame:
    """Array cells as columns, in fixed point."""
    return df.select(*keep, *[(fixed.to_fixed(F.col(column)[i]) if to_fixed else F.col(column)[i]).alias(f"{names}{i}") for i in range(n)])


def _fx(e: str) -> str:
    return f"CAST(trunc(({e}) * 65536) AS BIGINT)"


def _dist(j: int, c: list[list[float]] = CENTROIDS) -> str:
    return "0.0" + "".join(f" + (f{i} - ({c[j][i]})) * (f{i} - ({c[j][i]}))" for i in range(D))


_RAW = "raw AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, CAST(l_orderkey % 2 AS INTEGER) AS client_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(COLUMNS)) + " FROM lineitem)"
_PTS = _RAW + ", mm AS (SELECT " + ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(D)) + " FROM raw), pts AS (SELECT point_id, client_id, " + ", ".join(f"CASE WHEN hi{i} = lo{i} THEN 0.0 ELSE (x{i} - lo{i}) / (hi{i} - lo{i}) * 2 - 1 END AS f{i}" for i in range(D)) + " FROM raw, mm)"


def _assign(radius: float | None = None, name: str = "a") -> str:
    ds = "[" + ", ".join(_dist(j) for j in range(K)) + "]"
    near = "CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER)"
    if radius is not None:
        near = f"CASE WHEN list_min(ds) > {radius * radius!r} THEN {K} ELSE {near} END"
    return f"{name}0 AS (SELECT *, {ds} AS ds FROM pts), {name} AS (SELECT *, {near} AS cluster, list_min(ds) AS min_d2 FROM {name}0)"


_SUMS = "sums AS (SELECT client_id, cluster, count(*) AS n, " + ", ".join(f"CAST(sum({_fx(f'f{i}')}) AS BIGINT) AS s{i}" for i in range(D)) + " FROM a GROUP BY ALL)"
_CVALUES = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {', '.join(map(str, row))})" for j, row in enumerate(CENTROIDS)) + ") AS v(cluster, " + ", ".join(f"c{i}" for i in range(D)) + "))"
_GRID = _CVALUES + ", stats AS (SELECT g.client_id, c.cluster, coalesce(n, 1) AS n, " + ", ".join(f"coalesce(s{i}, {_fx(f'c{i}')}) AS s{i}" for i in range(D)) + " FROM (SELECT DISTINCT client_id FROM pts) g CROSS JOIN c LEFT JOIN sums ON sums.client_id = g.client_id AND sums.cluster = c.cluster)"
_REL = "rel AS (SELECT client_id, stats.cluster, n, " + ", ".join(f"{_fx(f's{i} / 65536.0 - c{i} * n')} AS s{i}" for i in range(D)) + " FROM stats JOIN c ON stats.cluster = c.cluster)"
_S = ", ".join(f"s{i}" for i in range(D))
_SUM_S = "CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"CAST(sum(s{i}) AS BIGINT) AS s{i}" for i in range(D))


# sources and projections


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, CAST(p_partkey AS DOUBLE) AS f1 FROM part WHERE p_partkey % 10 <> 0")
def load_txt_filter(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("x y "), F.col("p_size"))).otherwise(F.concat(F.lit("  "), F.col("p_size"), F.lit("   "), F.col("p_partkey"), F.lit(" ")))
    got = P.parse_points(table(spark, sf_dir, "part").select(line.alias("value")))
    return got.select(F.col("features")[1].cast("bigint").alias("p_partkey"), F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("SELECT printf('%.6f %.6f', CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE) / 4) AS value FROM supplier")
def save_txt_lines(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey") / 4.0).alias("features"))
    return P.format_points(df)


@query("SELECT CAST(c_custkey AS DOUBLE) AS f0, c_acctbal AS f1 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def ingest_columns(spark, sf_dir):
    """Delimited lines: short ones and those with a cell that is no number go."""
    key = F.col("c_custkey")
    line = F.when(key % 5 == 0, F.concat_ws(",", key, F.lit("1"))).when(key % 7 == 0, F.concat_ws(", ", key, F.lit("a"), F.lit("?"))).otherwise(F.concat_ws(", ", key, F.lit("a"), F.col("c_acctbal").cast("string")))
    got = P.ingest_delimited(table(spark, sf_dir, "customer").select(line.alias("value")), (0, 2), 3, r"\s*,\s*")
    return got.select(F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query(f"WITH {_PTS} SELECT point_id, {', '.join(f'{_fx(f"f{i}")} AS q{i}' for i in range(D))} FROM pts")
def normalize_minmax(spark, sf_dir):
    return wide(P.normalize(raw_points(spark, sf_dir), D, fixed=True), "features", "q", "point_id", to_fixed=False)


@query("SELECT p_partkey, CAST(trunc(p_retailprice * 65536) AS BIGINT) AS q, CAST(trunc(-p_retailprice / 7) AS BIGINT) AS i FROM part")
def to_fixed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fixed.to_fixed(F.col("p_retailprice")).alias("q"), fixed.to_int(-F.col("p_retailprice") / 7).alias("i"))


@query("SELECT l_orderkey, l_linenumber, l_partkey / 65536.0 AS x FROM lineitem")
def unscale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fixed.unscale(F.col("l_partkey")).alias("x"))


@query(f"WITH {_PTS} SELECT point_id, {', '.join(f'{_fx(_dist(j))} AS d{j}' for j in range(K))} FROM pts")
def sq_distances(spark, sf_dir):
    return wide(scaled_points(spark, sf_dir).withColumn("ds", V.sq_distances(F.col("features"), CENTROIDS)), "ds", "d", "point_id", n=K)


@query(f"WITH {_PTS}, {_assign()} SELECT point_id, cluster, {_fx('sqrt(min_d2)')} AS distance FROM a")
def assign_nearest(spark, sf_dir):
    return stats.assigned(scaled_points(spark, sf_dir), CENTROIDS).select("point_id", "cluster", fixed.to_fixed(F.sqrt("min_d2")).alias("distance"))


@query(f"WITH {_PTS}, {_assign(RADIUS)} SELECT point_id, CAST(cluster AS INTEGER) AS cluster FROM a")
def assign_radius(spark, sf_dir):
    return stats.assigned(scaled_points(spark, sf_dir), CENTROIDS, RADIUS).select("point_id", "cluster")


@query("SELECT l_orderkey, l_linenumber, greatest(-1.0, least(1.0, l_quantity / 16 - 2)) AS v FROM lineitem")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.truncate(F.col("l_quantity") / 16 - 2).alias("v"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 - 3.5 + 1 AS u FROM lineitem), m AS (SELECT *, u - 4 * floor(u / 4) AS v FROM x) SELECT l_orderkey, l_linenumber, -1 + CASE WHEN v > 2 THEN 4 - v ELSE v END AS v FROM m")
def fold(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.fold(F.col("l_quantity") / 8 - 3.5).alias("v"))


_CLIP = f"WITH {_PTS}, m AS (SELECT *, sqrt({_dist(0)}) AS norm FROM pts) SELECT point_id, " + ", ".join(f"{_fx(f'CASE WHEN norm > 0.5 THEN ({CENTROIDS[0][i]}) + 0.5 * (f{i} - ({CENTROIDS[0][i]})) / norm ELSE f{i} END')} AS m{i}" for i in range(D)) + " FROM m"


@query(_CLIP)
def clip_move(spark, sf_dir):
    return wide(scaled_points(spark, sf_dir).withColumn("m", V.clip_move(V.vector(CENTROIDS[0]), F.col("features"), 0.5)), "m", "m", "point_id")


_PROJ = [" + ".join(["0.0", *[f"f{i} * ({BASIS[i][j]})" for i in range(D)]]) for j in range(2)]


@query(f"WITH {_PTS} SELECT point_id, {_fx(_PROJ[0])} AS p0, {_fx(_PROJ[1])} AS p1 FROM pts")
def project_basis(spark, sf_dir):
    return wide(scaled_points(spark, sf_dir).withColumn("p", V.project(F.col("features"), BASIS)), "p", "p", "point_id", n=2)


_LABEL = f"CAST(CASE WHEN {_PROJ[0]} >= 0 THEN 1 ELSE 0 END + CASE WHEN {_PROJ[1]} >= 0 THEN 2 ELSE 0 END AS INTEGER) AS label"


@query(f"WITH {_PTS} SELECT point_id, {_LABEL} FROM pts")
def sign_label(spark, sf_dir):
    return ortho.ortho_assign(scaled_points(spark, sf_dir), np.array(BASIS)).select("point_id", "label")


@query("WITH m AS (SELECT CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) / count(*) AS a FROM part) SELECT p_partkey, round(p_size - a, 6) AS x FROM part, m")
def center(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("features"))
    means = df.agg(F.array(F.sum(F.col("features")[0]) / F.count("*")).alias("means"))
    return df.crossJoin(F.broadcast(means)).select("p_partkey", F.round(V.center(F.col("features"), F.col("means"))[0], 6).alias("x"))


_NAMES = ["Synth_4_8_1", "SynthNew_32_512_2", "AblateSynth_2_16_3", "timesynth_5_2_100000", "g2-16-30", "dim64", "iris"]


@query("SELECT * FROM (VALUES ('Synth_4_8_1', 4, 8, NULL), ('SynthNew_32_512_2', 32, 512, NULL), ('AblateSynth_2_16_3', 2, 16, NULL), ('timesynth_5_2_100000', 5, 2, 100000), ('g2-16-30', 2, 16, NULL), ('dim64', NULL, 64, NULL), ('iris', NULL, NULL, NULL)) AS v(dataset, k, d, n)")
def parse_names(spark, sf_dir):
    return P.parse_names(spark.createDataFrame([(x,) for x in _NAMES], "dataset string"))


# the split among clients, statistics, masks


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(CASE WHEN k > CAST(trunc(0.5 * n) AS BIGINT) + CAST(trunc(0.3 * n) AS BIGINT) THEN 2 WHEN k > CAST(trunc(0.5 * n) AS BIGINT) THEN 1 ELSE 0 END AS INTEGER) AS client_id FROM r")
def shuffle_and_split(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"))
    return P.shuffle_and_split(df, [0.5, 0.3, 0.2], 7).select(F.col("point_id").alias("p_partkey"), F.col("client_id").cast("int").alias("client_id"))


def _clients(spark, sf_dir) -> DataFrame:
    """From the rows as they are: neither ranges nor assignments are needed for it."""
    return raw_points(spark, sf_dir).select("client_id").distinct()


def _local(spark, sf_dir, radius: float | None = RADIUS, kernel: str = "numpy") -> DataFrame:
    pts = scaled_points(spark, sf_dir)
    sums = stats.local_sums(pts, CENTROIDS, radius, kernel).where(F.col("cluster") < K)
    return stats.with_phantoms(sums, _clients(spark, sf_dir), CENTROIDS)


@query(f"WITH {_PTS}, {_assign(RADIUS)}, {_SUMS}, {_GRID} SELECT client_id, CAST(cluster AS INTEGER) AS cluster, n, {_S} FROM stats")
def local_stats(spark, sf_dir):
    return _local(spark, sf_dir)


@query(f"WITH {_PTS}, {_assign(FAR)}, {_SUMS}, {_GRID} SELECT client_id, CAST(cluster AS INTEGER) AS cluster, n, {_S} FROM stats")
def local_stats_empty(spark, sf_dir):
    return _local(spark, sf_dir, FAR, "sql")


@query(f"WITH {_PTS}, {_assign(RADIUS)}, {_SUMS}, {_GRID}, {_REL} SELECT client_id, CAST(cluster AS INTEGER) AS cluster, n, {_S} FROM rel")
def relative_totals(spark, sf_dir):
    return stats.relative(_local(spark, sf_dir), CENTROIDS)


_STEP = f"WITH {_PTS}, {_assign(RADIUS)}, {_SUMS}, {_GRID}, {_REL} SELECT CAST(cluster AS INTEGER) AS cluster, {_SUM_S} FROM rel GROUP BY cluster"


@query(_STEP)
def secure_sum(spark, sf_dir):
    return stats.secure_sum(stats.relative(_local(spark, sf_dir, kernel="sql"), CENTROIDS), D)


@query(_STEP)
def federated_step(spark, sf_dir):
    """Normalise, assign within a radius, sum by client, mask, add up, unmask."""
    local = stats.relative(_local(spark, sf_dir), CENTROIDS)
    clients = _clients(spark, sf_dir)
    return stats.unmask(stats.secure_sum(stats.masked(local, D, 1337, 0), D), stats.mask_sums(clients, K, D, 1337, 0), D)


@query(f"WITH {_PTS}, {_assign(RADIUS)} SELECT count(*) FILTER (WHERE cluster = {K}) AS unassigned FROM a")
def unassigned(spark, sf_dir):
    return stats.assigned(scaled_points(spark, sf_dir), CENTROIDS, RADIUS).agg(F.count_if(F.col("cluster") == K).alias("unassigned"))


def _mask(place: int) -> str:
    return f"CAST('0x' || substr(md5('5:2:' || client_id || ':' || cluster || ':{place}'), 1, 12) AS BIGINT)"


@query("WITH g AS (SELECT CAST(l_orderkey % 3 AS INTEGER) AS client_id, CAST(l_linenumber AS INTEGER) AS cluster, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s0 FROM lineitem GROUP BY ALL) "
       f"SELECT client_id, cluster, (n + {_mask(0)}) % {fixed.MOD} AS n, (s0 + {_mask(1)}) % {fixed.MOD} AS s0 FROM g")
def mask_values(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 3).cast("int").alias("client_id"), F.col("l_linenumber").cast("int").alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("s0"))
    return stats.masked(g, 1, 5, 2)


def _two() -> str:
    def step(name: str, src: str, out: str) -> str:
        row = ", ".join(f"max(CASE WHEN cluster = {j} THEN c{i} END) AS k{j}{i}" for j in range(K) for i in range(D))
        ds = "[" + ", ".join("0.0" + "".join(f" + (f{i} - k{j}{i}) * (f{i} - k{j}{i})" for i in range(D)) for j in range(K)) + "]"
        fx = ", ".join(f"CAST(sum({_fx(f'f{i}')}) AS BIGINT) AS s{i}" for i in range(D))
        fill = ", ".join(f"coalesce(s{i}, {_fx(f'{src}.c{i}')}) AS s{i}" for i in range(D))
        return (f"{name}w AS (SELECT {row} FROM {src}), {name}d AS (SELECT client_id, {', '.join(f'f{i}' for i in range(D))}, {ds} AS ds FROM pts, {name}w), "
                f"{name}s AS (SELECT client_id, list_position(ds, list_min(ds)) - 1 AS cluster, count(*) AS n, {fx} FROM {name}d GROUP BY ALL), "
                f"{name}g AS (SELECT {src}.cluster, coalesce(n, 1) AS n, {fill} FROM (SELECT DISTINCT client_id FROM pts) q CROSS JOIN {src} LEFT JOIN {name}s ON {name}s.client_id = q.client_id AND {name}s.cluster = {src}.cluster), "
                f"{out} AS (SELECT cluster, {', '.join(f'sum(s{i}) / 65536.0 / (sum(n) + 1e-9) AS c{i}' for i in range(D))} FROM {name}g GROUP BY cluster)")

    return f"WITH {_PTS}, {_CVALUES}, {step('u', 'c', 'c2')}, {step('v', 'c2', 'c3')} SELECT CAST(cluster AS INTEGER) AS cluster, {', '.join(f'{_fx(f"c{i}")} AS q{i}' for i in range(D))} FROM c3"


@query(_two())
def lloyd_two_steps(spark, sf_dir):
    got = federated_lloyd(scaled_points(spark, sf_dir), Params(k=K, dim=D, data_size=1000, iters=2), start=np.array(CENTROIDS))
    return spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(got.centroids_fixed)], "cluster int, " + ", ".join(f"q{i} long" for i in range(D)))


# the projection clusterer


@query(f"WITH {_PTS}, l AS (SELECT *, {_LABEL} FROM pts) SELECT label, count(*) AS count, {', '.join(f'round(avg(f{i}), 6) AS c{i}' for i in range(D))} FROM l GROUP BY label")
def cluster_means(spark, sf_dir):
    got = ortho.cluster_centers(ortho.ortho_assign(scaled_points(spark, sf_dir), np.array(BASIS)), D)
    return got.select("label", "count", *[F.round(F.col("center")[i], 6).alias(f"c{i}") for i in range(D)])


@query(f"WITH {_PTS}, l AS (SELECT *, {_LABEL} FROM pts) SELECT label, count(*) AS count FROM l GROUP BY label")
def cluster_counts(spark, sf_dir):
    return ortho.cluster_counts(ortho.ortho_assign(scaled_points(spark, sf_dir), np.array(BASIS)))


@query(f"WITH {_PTS}, l AS (SELECT *, {_LABEL} FROM pts), n AS (SELECT label, count(*) AS count FROM l GROUP BY label) SELECT min(count) AS count_min, max(count) AS count_max, avg(count) AS count_mean, round(stddev_pop(count), 6) AS count_std, count(*) AS occupied_quadrants FROM n")
def quadrant_stats(spark, sf_dir):
    got = ortho.quadrant_stats(ortho.cluster_counts(ortho.ortho_assign(scaled_points(spark, sf_dir), np.array(BASIS))))
    return got.withColumn("count_std", F.round("count_std", 6))


_W = f"least(1.0, 1.0 / (2 * sqrt(0.0{''.join(f' + f{i} * f{i}' for i in range(D))}) * sqrt(({_PROJ[0]}) * ({_PROJ[0]}) + ({_PROJ[1]}) * ({_PROJ[1]})) + 1e-8))"


@query(f"WITH {_PTS}, w AS (SELECT *, {_W} AS w, {_PROJ[0]} AS p0, {_PROJ[1]} AS p1 FROM pts) SELECT {', '.join(f'round(sum(-2 * w * f{i} * p{j}), 4) AS g{i}{j}' for i in range(D) for j in range(2))} FROM w")
def clipped_gradient_sum(spark, sf_dir):
    x = F.col("features")
    rows = scaled_points(spark, sf_dir).withColumn("p", V.project(x, BASIS)).withColumn("w", V.clipped_gradient_weight(x, F.col("p"), 1.0))
    return rows.agg(*[F.round(F.sum(-2 * F.col("w") * x[i] * F.col("p")[j]), 4).alias(f"g{i}{j}") for i in range(D) for j in range(2)])


# metrics


@query(f"WITH {_PTS}, {_assign()}, {_CVALUES}, n AS (SELECT cluster, count(*) AS n, sum(min_d2) AS w FROM a GROUP BY cluster), m AS (SELECT {', '.join(f'avg(f{i}) AS m{i}' for i in range(D))} FROM pts) "
       f"SELECT round(sum(w), 4) AS wcss, round(sum(w) / sum(n), 6) AS nicv, round(sum(n * ({' + '.join(f'(c{i} - m{i}) * (c{i} - m{i})' for i in range(D))})), 4) AS bcss, CAST({K} - count(*) AS INTEGER) AS empty_clusters FROM n JOIN c ON n.cluster = c.cluster, m")
def variance_metrics(spark, sf_dir):
    got = metrics.one_pass(scaled_points(spark, sf_dir), CENTROIDS)
    return got.select(F.round("wcss", 4).alias("wcss"), F.round("nicv", 6).alias("nicv"), F.round("bcss", 4).alias("bcss"), "empty_clusters")


def _embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("features"), F.col("label").alias("cluster"))


_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_LONG = "t AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)"


@query(f"WITH {_EMB}, p AS (SELECT a.vec_id AS a, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY ALL), "
       "o AS (SELECT a, la, s / (n - 1) AS d, n FROM p WHERE la = lb), q AS (SELECT a, min(s / n) AS b FROM p WHERE la <> lb GROUP BY a) "
       "SELECT round(avg(CASE WHEN n > 1 THEN (b - d) / greatest(b, d) ELSE 0 END), 6) AS silhouette FROM o JOIN q USING (a)")
def silhouette(spark, sf_dir):
    return metrics.silhouette(_embedded(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {_EMB}, p AS (SELECT a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id) SELECT round(min(d) FILTER (WHERE la <> lb) / max(d) FILTER (WHERE la = lb), 6) AS dunn FROM p")
def dunn(spark, sf_dir):
    return metrics.dunn(_embedded(spark, sf_dir)).select(F.round("dunn", 6).alias("dunn"))


@query(f"WITH {_EMB}, {_LONG}, m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM t GROUP BY ALL) GROUP BY label), s AS (SELECT label, avg(list_distance(v, m)) AS s, any_value(m) AS m FROM e JOIN m USING (label) GROUP BY label), "
       "r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir):
    return metrics.davies_bouldin(_embedded(spark, sf_dir), 64).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"WITH {_EMB}, {_LONG}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), c AS (SELECT label, i, avg(x) AS m, sum(x * x) AS q, sum(x) AS s FROM t GROUP BY ALL), g AS (SELECT i, avg(x) AS m FROM t GROUP BY i), "
       "b AS (SELECT sum(n * (c.m - g.m) * (c.m - g.m)) AS b, sum(c.q - c.s * c.s / n) AS w FROM c JOIN n USING (label) JOIN g USING (i)) SELECT round((b / ((SELECT count(*) FROM n) - 1)) / (w / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n))), 6) AS calinski_harabasz FROM b")
def calinski_harabasz(spark, sf_dir):
    return metrics.calinski_harabasz(_embedded(spark, sf_dir), 64).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


# result tables


def results(spark, sf_dir) -> DataFrame:
    """lineitem as a stand-in for a result table."""
    cents = F.round(F.col("l_tax") * 100).cast("bigint")
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("dataset"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("dp"), F.round("l_discount", 2).alias("eps"))
    return out.agg((F.sum(cents) / F.count("*")).alias("nicv"), F.count("*").alias("runs"))


_RES = "res AS (SELECT CAST(l_linenumber AS INTEGER) AS dataset, l_returnflag AS method, l_linestatus AS dp, round(l_discount, 2) AS eps, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) / count(*) AS nicv, count(*) AS runs FROM lineitem GROUP BY ALL)"
_AUC = "st AS (SELECT *, (eps - lag(eps) OVER w) * (nicv + lag(nicv) OVER w) / 2 AS part FROM res WINDOW w AS (PARTITION BY dataset, method, dp ORDER BY eps)), auc AS (SELECT dataset, method, dp, CASE WHEN count(*) = 1 THEN any_value(nicv) * 0.9 ELSE sum(part) END AS auc FROM st GROUP BY ALL)"


@query(f"WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {A.t_quantile(i)!r})' for i in range(1, 200))}) AS v(df, t)), g AS (SELECT s_nationkey, count(s_acctbal) AS n, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier GROUP BY ALL) "
       "SELECT s_nationkey, n, round(m, 4) AS mean, round(CASE WHEN n = 1 THEN 0.0 ELSE sd / sqrt(n) * t END, 4) AS half_width FROM g LEFT JOIN t ON df = n - 1")
def mean_ci(spark, sf_dir):
    got = A.mean_ci(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    return got.select("s_nationkey", "n", F.round("mean", 4).alias("mean"), F.round("half_width", 4).alias("half_width"))


@query(f"WITH {_RES}, {_AUC} SELECT dataset, method, dp, round(auc, 6) AS auc FROM auc")
def auc_eps(spark, sf_dir):
    got = A.auc(results(spark, sf_dir), ["dataset", "method", "dp"], "eps", "nicv")
    return got.withColumn("auc", F.round("auc", 6))


@query(f"WITH {_RES} SELECT dataset, method, dp, eps, round(nicv, 6) AS nicv FROM res QUALIFY row_number() OVER (PARTITION BY dataset, method, dp ORDER BY nicv, eps) = 1")
def best_by_group(spark, sf_dir):
    got = A.best_by(results(spark, sf_dir), ["dataset", "method", "dp"], "nicv", ["eps"])
    return got.select("dataset", "method", "dp", "eps", F.round("nicv", 6).alias("nicv"))


@query(f"WITH {_RES} SELECT dataset, method, dp, eps, runs FROM res QUALIFY row_number() OVER (PARTITION BY dataset, method ORDER BY eps, dp) = 1")
def first_by_group(spark, sf_dir):
    return A.first_by(results(spark, sf_dir), ["dataset", "method"], ["eps", "dp"]).select("dataset", "method", "dp", "eps", "runs")


_CELL = "cells AS (SELECT dataset, eps, method, CAST(sum(runs) AS BIGINT) AS runs FROM res WHERE dp = 'F' GROUP BY ALL)"


@query(f"WITH {_RES}, {_CELL} SELECT a.dataset, a.eps, round((a.runs - b.runs) / a.runs, 6) AS ratio FROM cells a JOIN cells b ON a.dataset = b.dataset AND a.eps = b.eps WHERE a.method = 'A' AND b.method = 'R'")
def ratio_matrix(spark, sf_dir):
    cells = results(spark, sf_dir).where("dp = 'F'").groupBy("dataset", "eps", "method").agg(F.sum("runs").alias("runs"))
    side = lambda m: cells.where(F.col("method") == m).drop("method")
    return A.ratio_matrix(side("A"), side("R"), ["dataset", "eps"], "runs").withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_RES}, {_AUC} SELECT dataset, {', '.join(f"max(CASE WHEN method = '{m}' THEN round(auc, 6) END) AS {m}" for m in 'ANR')} FROM auc WHERE dp = 'F' GROUP BY dataset")
def pivot_matrix(spark, sf_dir):
    got = A.auc(results(spark, sf_dir).where("dp = 'F'"), ["dataset", "method"], "eps", "nicv").withColumn("auc", F.round("auc", 6))
    return A.pivot_matrix(got, "dataset", "method", "auc", ["A", "N", "R"])


@query(f"WITH {_RES}, {_AUC}, s AS (SELECT dp, method, sum(auc) AS auc FROM auc GROUP BY ALL) SELECT dp, method, round(auc, 6) AS auc, round(auc / coalesce(max(CASE WHEN method = 'N' THEN auc END) OVER (PARTITION BY dp), 1.0), 6) AS relative_auc FROM s")
def auc_normalised(spark, sf_dir):
    got = A.normalised_auc(A.auc(results(spark, sf_dir), ["dataset", "method", "dp"], "eps", "nicv"), "dp", "method", "N")
    return got.select("dp", "method", F.round("auc", 6).alias("auc"), F.round("relative_auc", 6).alias("relative_auc"))


@query(f"WITH {_RES}, b AS (SELECT dataset, nicv AS base FROM res WHERE method = 'A' AND dp = 'F' AND eps = 0.05) SELECT method, eps, round(avg(nicv / base), 6) AS normalised FROM res JOIN b USING (dataset) GROUP BY ALL")
def ablation_avg(spark, sf_dir):
    res = results(spark, sf_dir)
    base = res.where("method = 'A' and dp = 'F' and eps = 0.05")
    return A.against_baseline(res, base, "dataset", "nicv").groupBy("method", "eps").agg(F.round(F.avg("normalised"), 6).alias("normalised"))


@query(f"WITH {_RES} SELECT round(min(nicv), 6) AS vmin, round(max(nicv), 6) AS vmax FROM res")
def value_range(spark, sf_dir):
    return A.value_range(results(spark, sf_dir).withColumn("nicv", F.round("nicv", 6)), "nicv")


@query(f"WITH {_RES}, s AS (SELECT *, CASE WHEN method = 'N' THEN NULL WHEN method = 'R' THEN 0.5 ELSE 0.0 END AS sigma FROM res) SELECT dataset, method, dp, eps FROM s WHERE abs(coalesce(sigma, 0)) <= 1e-8")
def sigma_filter(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("sigma", F.when(F.col("method") == "N", F.lit(None)).when(F.col("method") == "R", 0.5).otherwise(0.0))
    return A.sigma_filter(rows).select("dataset", "method", "dp", "eps")


@query(f"WITH {_RES}, g AS (SELECT dataset, method, count(*) AS n, avg(nicv) AS m, stddev_samp(nicv) AS s FROM res GROUP BY ALL) SELECT dataset, method, round(m - s, 6) AS low, round(m + s, 6) AS high FROM g")
def confidence_band(spark, sf_dir):
    g = results(spark, sf_dir).groupBy("dataset", "method").agg(F.avg("nicv").alias("m"), F.stddev_samp("nicv").alias("s"))
    return A.band(g, "m", "s").select("dataset", "method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("WITH r AS (SELECT l_returnflag AS dataset, CAST(l_linenumber AS INTEGER) AS k, 4 AS d, CAST(count(*) AS BIGINT) AS n, CASE WHEN l_linestatus = 'F' THEN 0.000125 ELSE 0.025 END AS delay, count(*) / 1000 AS elapsed, 7 AS iters, CAST(count(*) * 70 AS BIGINT) AS comm_size FROM lineitem GROUP BY l_returnflag, l_linenumber, l_linestatus), "
       "q AS (SELECT dataset, k, d, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL) SELECT q.dataset, q.n, q.k, q.d, round(max(CASE WHEN delay < 0.001 THEN elapsed / iters * 1000 END), 2) AS lan_ms, round(max(CASE WHEN delay > 0.001 THEN elapsed / iters * 1000 END), 2) AS wan_ms, CAST(floor(sum(CASE WHEN delay < 0.001 THEN comm_size / iters END)) AS BIGINT) AS comm_bytes FROM r JOIN q ON r.dataset = q.dataset AND r.k = q.k GROUP BY ALL")
def timing_table(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").cast("int").alias("k"), "l_linestatus").agg(F.count("*").alias("m"))
    n = r.groupBy("dataset", "k").agg(F.sum("m").alias("n"))
    r = r.join(n, ["dataset", "k"]).select("dataset", "n", "k", F.lit(4).alias("d"), F.when(F.col("l_linestatus") == "F", 0.000125).otherwise(0.025).alias("delay"), (F.col("m") / 1000).alias("elapsed"), F.lit(7).alias("iters"), (F.col("m") * 70).alias("comm_size"))
    return A.timing_table(r)


@query("SELECT n_nationkey, CAST(2 * (n_nationkey % 7 + 2) * 8 * (n_nationkey + 1) * (n_regionkey + 2) AS BIGINT) AS bytes FROM nation")
def comm_bytes(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", params.comm_bytes(n % 7 + 2, n + 1, F.col("n_regionkey") + 1).cast("bigint").alias("bytes"))


_RUNS = {"A": ("none", "none", "none"), "N": ("none", "laplace", "none"), "R": ("diagonal_then_frac", "gaussiananalytic", "fold")}


@query(f"WITH {_RES}, a AS (SELECT dataset, CASE method WHEN 'A' THEN 'Lloyd' WHEN 'N' THEN 'SuLloyd' ELSE 'Flagship' END AS label, nicv FROM res WHERE dp = 'F' QUALIFY row_number() OVER (PARTITION BY dataset, method ORDER BY nicv, eps) = 1), "
       "o AS (SELECT *, CASE method WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.0 END AS sigma FROM res WHERE dp = 'O'), b AS (SELECT dataset, CASE WHEN coalesce(sigma, 0) = 0 THEN 'Ortho' ELSE 'Ortho-DP' END AS label, nicv FROM o QUALIFY row_number() OVER (PARTITION BY dataset, sigma ORDER BY nicv, eps) = 1) "
       "SELECT dataset, label, round(nicv, 6) AS nicv FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def union_summary(spark, sf_dir):
    """Best rows of each protocol under their names in tables."""
    res, kind = results(spark, sf_dir), F.create_map(*[x for k, v in _RUNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("method")]
    local = res.where("dp = 'F'").select("dataset", "eps", "nicv", kind[0].alias("method"), kind[1].alias("dp"), kind[2].alias("post"))
    projected = res.where("dp = 'O'").select("dataset", "nicv", F.col("eps").alias("d_prime"), F.when(F.col("method") == "R", 0.5).when(F.col("method") == "A", 0.0).alias("sigma"))
    return A.protocol_summary(local, projected).withColumn("nicv", F.round("nicv", 6))


@query(f"WITH {_RES} SELECT dataset, CASE method WHEN 'A' THEN 'random' WHEN 'N' THEN 'svd_pca' ELSE 'dpsgd_pca' END AS basis_method, CASE dp WHEN 'F' THEN 1 ELSE 2 END AS d_prime, round(nicv, 6) AS nicv, eps AS basis_epsilon FROM res QUALIFY row_number() OVER (PARTITION BY dataset, method, dp ORDER BY nicv, eps) = 1")
def basis_summary(spark, sf_dir):
    m = F.col("method")
    rows = results(spark, sf_dir).select("dataset", "nicv", F.col("eps").alias("basis_epsilon"), F.when(m == "A", "random").when(m == "N", "svd_pca").otherwise("dpsgd_pca").alias("basis_method"), F.when(F.col("dp") == "F", 1).otherwise(2).alias("d_prime"), F.lit(0.0).alias("sigma"))
    return A.basis_summary(rows).select("dataset", "basis_method", "d_prime", F.round("nicv", 6).alias("nicv"), "basis_epsilon")


@query(f"WITH {_RES} SELECT method, CAST(dataset % 3 AS INTEGER) AS k, CASE dp WHEN 'F' THEN 2 ELSE 4 END AS d, count(*) AS replicates, round(avg(nicv), 6) AS nicv FROM res GROUP BY ALL")
def replicate_mean(spark, sf_dir):
    rows = results(spark, sf_dir).select("method", (F.col("dataset") % 3).alias("k"), F.when(F.col("dp") == "F", 2).otherwise(4).alias("d"), "nicv")
    return A.replicate_mean(rows, "nicv").withColumn("nicv", F.round("nicv", 6))


_CONFIGS = [(k, d, n, e, dp, m) for k in (2, 3, 5, 15) for d in (1, 2, 4, 8) for n in (1500, 60_000, 1_000_000) for e in (0.25, 1.0) for dp in ("laplace", "gaussiananalytic") for m in ("none", "diagonal_then_frac")]
_CONFIG_ROWS = ", ".join(f"({k}, {d}, {n}, {e}::DOUBLE, '{dp}', '{m}', {params.analytic_gaussian_scale(e, 1 / (n * np.log(n)))!r}::DOUBLE)" for k, d, n, e, dp, m in _CONFIGS)


@query(f"""WITH c AS (SELECT *, sqrt(d) * 2 AS diag, 0.8::DOUBLE / (2 * pow(k, 1.0::DOUBLE / d)) AS frac, cbrt(4 * d * pow(0.225::DOUBLE, 2)) AS counts, n::DOUBLE * n / (k * k * k) AS room FROM (VALUES {_CONFIG_ROWS}) AS v(k, d, n, eps, dp, method, scale)),
m AS (SELECT *, CASE WHEN dp = 'laplace' THEN eps / sqrt(500 / room * pow(d + counts, 3)) WHEN method = 'none' THEN 0.004::DOUBLE * room / (d * pow(0.45::DOUBLE + sqrt(d), 2) * pow(scale, 2)) ELSE 0.016::DOUBLE * room / (pow(diag * frac, 2) * pow(1 + sqrt(4 * d), 2) * pow(scale, 2)) END AS rounds FROM c),
i AS (SELECT *, CAST(least(7, greatest(2, floor(least(rounds, 100)))) AS INTEGER) AS iters, CASE WHEN dp = 'laplace' THEN d ELSE diag END AS most FROM m)
SELECT k, d, n, eps, dp, method, iters, round(eps / iters * d / (d + counts), 9) AS sum_eps, round(eps / iters * counts / (d + counts), 9) AS count_eps,
round(CASE WHEN method = 'none' OR diag / 2 >= most THEN diag ELSE diag / 2 END, 9) AS first_radius, round(CASE WHEN method = 'none' OR diag * frac >= most THEN diag ELSE diag * frac END, 9) AS radius FROM i""")
def run_parameters(spark, sf_dir):
    """Rounds, budget of sums and counts, and radii that follow from a configuration."""
    rows = []
    for k, d, n, e, dp, m in _CONFIGS:
        p = Params(k=k, dim=d, data_size=n, eps=e, dp=dp, method=m, alpha=0.8)
        rows.append((k, d, n, e, dp, m, p.iters, *[round(v, 9) for v in (*p.split_epsilon(), p.max_dist(0), p.max_dist(1))]))
    return spark.createDataFrame(rows, "k int, d int, n int, eps double, dp string, method string, iters int, sum_eps double, count_eps double, first_radius double, radius double")


@query("SELECT DISTINCT l_returnflag AS method, l_linestatus AS dp FROM lineitem")
def combinations(spark, sf_dir):
    return results(spark, sf_dir).select("method", "dp").dropDuplicates()


def _grid_sql() -> str:
    p = PRESETS["accuracy"]
    v = lambda xs, a: "(VALUES " + ", ".join(f"('{x}')" if isinstance(x, str) else f"(CAST({x} AS DOUBLE))" for x in xs) + f") AS {a}(v)"
    return f"SELECT DISTINCT m.v AS method, p.v AS post, d.v AS delay, x.v AS dp, CASE WHEN x.v = 'none' THEN 0.0::DOUBLE ELSE e.v END AS eps, CASE WHEN m.v = 'none' THEN 0.0::DOUBLE ELSE a.v END AS alpha FROM {v(p['methods'], 'm')}, {v(p['posts'], 'p')}, {v(p['delays'], 'd')}, {v(p['dps'], 'x')}, {v(p['eps_budgets'], 'e')}, {v(p['alphas'], 'a')}"


@query(_grid_sql())
def param_grid(spark, sf_dir):
    return sweep.grid_df(spark, "accuracy")


@query(f"WITH {_RES}, g AS (SELECT dataset, method, count(nicv) AS n, avg(nicv) AS m, stddev_samp(nicv) AS s, avg(CAST(runs AS DOUBLE)) AS r, stddev_samp(CAST(runs AS DOUBLE)) AS rs FROM res GROUP BY ALL), t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {A.t_quantile(i)!r})' for i in range(1, 60))}) AS v(df, t)) "
       "SELECT dataset, method, round(m, 5) AS nicv, round(s / sqrt(n) * t, 5) AS nicv_h, round(r, 4) AS runs, round(rs / sqrt(n) * t, 4) AS runs_h FROM g JOIN t ON df = n - 1")
def seeds_summary(spark, sf_dir):
    got = sweep.summarise(results(spark, sf_dir), ["dataset", "method"], ["nicv", "runs"])
    return got.select("dataset", "method", F.round("nicv", 5).alias("nicv"), F.round("nicv_h", 5).alias("nicv_h"), F.round("runs", 4).alias("runs"), F.round("runs_h", 4).alias("runs_h"))


def _named(spark, sf_dir) -> DataFrame:
    """Result rows under names of data sets, with configurations spelt out."""
    kind = F.create_map(*[x for k, v in _RUNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("method")]
    k, d = F.pow(F.lit(2), F.col("dataset")).cast("int"), F.when(F.col("dp") == "F", 512).otherwise(1024)
    name = F.when(F.col("dataset") == 7, "s1").otherwise(F.concat_ws("_", F.lit("SynthNew"), k, d, (F.col("runs") % 3 + 1)))
    return results(spark, sf_dir).select(name.alias("dataset"), kind[0].alias("method"), kind[1].alias("dp"), kind[2].alias("post"), F.when(kind[1] == "none", 0.0).otherwise(F.col("eps")).alias("eps"), "nicv", "runs")


_KIND = lambda i: "CASE method " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _RUNS.items()) + " END"
_NAMED = (f"named AS (SELECT CASE WHEN dataset = 7 THEN 's1' ELSE 'SynthNew_' || CAST(pow(2, dataset) AS INTEGER) || '_' || CASE dp WHEN 'F' THEN 512 ELSE 1024 END || '_' || (runs % 3 + 1) END AS dataset, "
          f"{_KIND(0)} AS method, {_KIND(1)} AS dp, {_KIND(2)} AS post, CASE WHEN method = 'A' THEN 0.0 ELSE eps END AS eps, nicv, runs FROM res)")


@query(f"WITH {_RES}, {_NAMED} SELECT dataset, eps, round(nicv, 6) AS nicv, runs FROM named WHERE dp = 'gaussiananalytic' AND method = 'diagonal_then_frac' AND post = 'fold' AND eps = 0.05 UNION ALL SELECT dataset, eps, round(nicv, 6), runs FROM named WHERE dp = 'none' AND eps = 0")
def result_cells(spark, sf_dir):
    rows = _named(spark, sf_dir)
    got = A.result_cell(rows, "gaussiananalytic", "diagonal_then_frac", "fold", 0.05).unionByName(A.result_cell(rows, "none", "none", "none", 0.05))
    return got.select("dataset", "eps", F.round("nicv", 6).alias("nicv"), "runs")


@query(f"WITH {_RES}, {_NAMED} SELECT dataset, method, eps, runs FROM named WHERE dp = 'none' OR eps <= 0.05")
def budget_filter(spark, sf_dir):
    return A.within_budget(_named(spark, sf_dir), 0.05).select("dataset", "method", "eps", "runs")


@query(f"WITH {_RES}, {_NAMED}, p AS (SELECT *, CAST(split_part(dataset, '_', 2) AS INTEGER) AS k, CAST(split_part(dataset, '_', 3) AS INTEGER) AS d FROM named WHERE dataset LIKE 'Synth%') SELECT dataset, k, d, method, eps, runs FROM p WHERE k <= 32 AND d <= 512")
def heatmap_guard(spark, sf_dir):
    return A.heatmap_sets(_named(spark, sf_dir)).select("dataset", "k", "d", "method", "eps", "runs")


@query(f"WITH {_RES}, {_NAMED} SELECT dataset, method, dp, eps, runs FROM named WHERE dataset IN ({', '.join(f"'{x}'" for x in P.NUM_CLUSTERS)})")
def accepted_sets(spark, sf_dir):
    return A.accepted(_named(spark, sf_dir), list(P.NUM_CLUSTERS)).select("dataset", "method", "dp", "eps", "runs")


@query(f"WITH {_RES}, {_NAMED} SELECT eps, round(avg(nicv) FILTER (WHERE dataset LIKE 'SynthNew%' AND dataset LIKE '%2'), 6) AS nicv FROM named GROUP BY eps")
def key_average(spark, sf_dir):
    got = A.matching_average(_named(spark, sf_dir), "eps", "nicv", "SynthNew", "2")
    return got.withColumn("nicv", F.round("nicv", 6))


@query("WITH r AS (SELECT CAST(l_linenumber AS INTEGER) AS dataset, count(*) AS n FROM lineitem GROUP BY ALL) SELECT dataset, '$' || regexp_replace(printf('%.2f', round(n / 1000.0::DOUBLE / 7 * 1000, 2)), '0$', '') || ' \\pm ' || regexp_replace(printf('%.2f', round(n / 9000.0::DOUBLE / 7 * 1000, 2)), '0$', '') || '$' AS time FROM r")
def timing_cells(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("dataset")).agg(F.count("*").alias("n"))
    return r.select("dataset", A.timing_text(F.col("n") / 1000, F.col("n") / 9000, F.lit(7)).alias("time"))


_OUTLIERS = (0, 37, 100)


@query(f"WITH g AS (SELECT k, o, i FROM (VALUES {', '.join(f'({k})' for k in P.SCALE_CLUSTERS)}) AS a(k), (VALUES {', '.join(f'({o})' for o in _OUTLIERS)}) AS b(o), range(1, 33) AS r(i) WHERE i <= k), s AS (SELECT *, CAST(round_even(i / (k * (k + 1) / 2) * {P.SCALE_ROWS}, 0) AS BIGINT) AS part FROM g), "
       f"t AS (SELECT *, part + CASE WHEN i = k THEN {P.SCALE_ROWS} - sum(part) OVER (PARTITION BY k, o) ELSE 0 END AS size FROM s) SELECT k, o AS outliers, CAST(i - 1 AS INTEGER) AS cluster, CAST(size - round_even(o * (size / {P.SCALE_ROWS}), 0) AS BIGINT) AS size FROM t")
def scale_sizes(spark, sf_dir):
    """Points of each cluster of the generated scale sets."""
    rows = [(k, o, i, s) for k in P.SCALE_CLUSTERS for o in _OUTLIERS for i, s in enumerate(P.proportional_sizes(P.SCALE_ROWS, k, o))]
    return spark.createDataFrame(rows, "k int, outliers int, cluster int, size long")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('3:' || p_partkey), p_partkey) AS k, count(*) OVER () AS n FROM part) WHERE k <= greatest(16, CAST(trunc(n * 0.1) AS BIGINT))")
def exact_subsample(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"))
    return P.subsample(df, max(16, int(df.count() * 0.1)), 3).select(F.col("point_id").alias("p_partkey"))


_BENCH = [(d, s, basis.random_orthogonal_basis(D, d, s)) for d in (1, 2, 3) for s in (0, 1)]
_BENCH_LABELS = " UNION ALL ".join(f"SELECT {d} AS d_prime, {s} AS seed, {' + '.join(f'CASE WHEN 0.0{''.join(f' + f{i} * ({float(q[i, j])!r}::DOUBLE)' for i in range(D))} >= 0 THEN {1 << j} ELSE 0 END' for j in range(d))} AS label FROM pts" for d, s, q in _BENCH)


@query(f"WITH {_PTS}, l AS ({_BENCH_LABELS}), n AS (SELECT d_prime, seed, label, count(*) AS n FROM l GROUP BY ALL) SELECT d_prime, seed, CAST(1 << d_prime AS INTEGER) AS num_clusters, count(*) AS num_occupied, min(n) AS cluster_size_min, max(n) AS cluster_size_max, round(stddev_pop(n), 6) AS cluster_size_std FROM n GROUP BY ALL")
def basis_benchmark(spark, sf_dir):
    return ortho.basis_occupancy(scaled_points(spark, sf_dir), _BENCH).withColumn("cluster_size_std", F.round("cluster_size_std", 6))


_PERMUTED = " AND ".join(f"{a}.g <> {b}.g" for i, a in enumerate("wxyz") for b in "wxyz"[:i])


@query(f"WITH {_PTS}, {_CVALUES}, m AS (SELECT point_id % 8 % 4 AS g, {', '.join(f'avg(f{i}) AS m{i}' for i in range(D))} FROM pts GROUP BY ALL), e AS (SELECT g, cluster, sqrt({' + '.join(f'(m{i} - c{i}) * (m{i} - c{i})' for i in range(D))}) AS v FROM m, c) "
       f"SELECT round(min(w.v + x.v + y.v + z.v) / 4, 6) AS matched_mean_distance FROM e w, e x, e y, e z WHERE w.cluster = 0 AND x.cluster = 1 AND y.cluster = 2 AND z.cluster = 3 AND {_PERMUTED}")
def optimal_matching(spark, sf_dir):
    """Mean distance of the best assignment of groups' means to centroids."""
    means = metrics.cluster_means(scaled_points(spark, sf_dir).withColumn("cluster", F.col("point_id") % 8 % 4), D).collect()  # four rows
    value = metrics.matched_distance(np.array([r["mean"] for r in means]), np.array(CENTROIDS))
    return spark.createDataFrame([(round(value, 6),)], "matched_mean_distance double")


# without SQL: random or iterative


@query()
def private_lloyd(spark, sf_dir):
    """The flagship configuration over all of lineitem."""
    pts = scaled_points(spark, sf_dir)
    n = pts.count()
    return federated_lloyd(pts, Params(k=K, dim=D, data_size=n, dp="gaussiananalytic", eps=1.0, method="diagonal_then_frac", post="fold", alpha=0.8)).centroids_df(spark)


@query()
def private_ortho(spark, sf_dir):
    pts = scaled_points(spark, sf_dir)
    got = ortho.ortho_cluster(pts, Params(k=K, dim=D, data_size=pts.count(), d_prime=2, sigma=0.5))
    return spark.createDataFrame([(int(i), [float(v) for v in c]) for i, c in zip(got.labels, got.centroids)], "label int, center array<double>")


@query()
def svd_pca_basis(spark, sf_dir):
    q = basis.svd_pca_basis(scaled_points(spark, sf_dir), D, 2)
    return spark.createDataFrame([(i, *[round(float(v), 6) for v in row]) for i, row in enumerate(q)], "dim int, q0 double, q1 double")


@query()
def matched_centroids(spark, sf_dir):
    """Distance of a run's centroids to those of seeded k-means over the same points."""
    pts = scaled_points(spark, sf_dir).persist()
    truth = metrics.ground_truth(pts, K)
    got = federated_lloyd(pts, Params(k=K, dim=D, data_size=pts.count()))
    value = metrics.matched_distance(got.centroids, truth)
    pts.unpersist()
    return spark.createDataFrame([(value,)], "matched_mean_distance double")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
