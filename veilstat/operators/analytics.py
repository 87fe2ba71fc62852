"""Analytics over result tables: areas under privacy curves, best rows, ratios, pivots and summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def t_quantile(df: int, p: float = 0.975) -> float:
    """Student's t quantile, by halving over the regularised incomplete beta function."""
    def cdf(t: float) -> float:
        x = df / (df + t * t)
        return 1 - 0.5 * _beta(x, df / 2, 0.5)

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    while hi - lo > 1e-14 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
        if mid in (lo, hi) and hi - lo <= math.ulp(hi):
            break
    return (lo + hi) / 2


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def mean_ci(df: DataFrame, by: Sequence[str], value: str, most: int = 200) -> DataFrame:
    """by, n, mean and half of the 95 % interval; NaN and null values don't count, a group without any has null, one value has half width 0.

    Quantiles are a literal table up to `most` values a group; larger groups use the normal expansion of the t quantile.
    """
    v = F.when(~F.isnan(value), F.col(value))
    got = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    table = F.array(*[F.lit(t_quantile(i)) for i in range(1, most)])
    z = 1.959963984540054
    nu = F.col("n") - 1
    wide = z + (z**3 + z) / 4 / nu + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (nu * nu)
    t = F.when(nu < most, F.get(table, (nu - 1).cast("int"))).otherwise(wide)
    half = F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd") / F.sqrt("n") * t)
    return got.select(*by, "n", "mean", half.alias("half_width"))


def replicate_mean(df: DataFrame, value: str, by: Sequence[str] = ("method", "k", "d")) -> DataFrame:
    """Mean over replicates of a generated data set; NaN and null values don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("replicates"), F.avg(v).alias(value))


def auc(df: DataFrame, by: Sequence[str], x: str, y: str, single_width: float = 0.9) -> DataFrame:
    """Trapezoid area over x in each group; one point stands for the whole grid of width `single_width`."""
    w = Window.partitionBy(*by).orderBy(x)
    step = df.withColumn("_part", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    got = step.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_part").alias("area"), F.first(y).alias("only"))
    return got.select(*by, F.when(F.col("n") == 1, F.col("only") * single_width).otherwise(F.col("area")).alias("auc"))


def best_by(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The row of least value in each group; `ties` makes the choice definite."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ratio_matrix(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(A - B) / A by cell, 0 where B is 0."""
    j = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), list(keys))
    return j.select(*keys, F.when(F.col("_b") != 0, F.try_divide(F.col("_a") - F.col("_b"), F.col("_a"))).otherwise(0.0).alias("ratio"))


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def value_range(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def normalised_auc(areas: DataFrame, group: str, name: str, base: str) -> DataFrame:
    """Areas summed by group and name, over the sum that `base` has in the group, or 1 where it has none."""
    sums = areas.groupBy(group, name).agg(F.sum("auc").alias("auc"))
    b = F.max(F.when(F.col(name) == base, F.col("auc"))).over(Window.partitionBy(group))
    return sums.select(group, name, "auc", (F.col("auc") / F.coalesce(b, F.lit(1.0))).alias("relative_auc"))


def against_baseline(df: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Value over the baseline's value of the same key; `baseline` has a row for each key."""
    return df.join(baseline.select(key, F.col(value).alias("_base")), key).withColumn("normalised", F.try_divide(F.col(value), F.col("_base"))).drop("_base")


def sigma_filter(df: DataFrame, sigma: float | None = None, column: str = "sigma") -> DataFrame:
    """Rows whose sigma is close to the one wanted, null as 0; without a wish those of 0 if there are any, else all."""
    s = F.coalesce(F.col(column), F.lit(0.0))
    close = lambda v: F.abs(s - v) <= 1e-8 + 1e-5 * abs(v)
    if sigma is not None:
        return df.where(close(sigma))
    some = df.agg(F.max(close(0.0)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).where(~F.col("_some") | close(0.0)).drop("_some")


def band(df: DataFrame, mean: str, half: str) -> DataFrame:
    return df.withColumn("low", F.col(mean) - F.col(half)).withColumn("high", F.col(mean) + F.col(half))


def result_cell(df: DataFrame, dp: str, method: str, post: str, eps: float | None = None) -> DataFrame:
    """Rows of one configuration; without a mechanism the budget is 0 whatever is asked for."""
    rows = df.where((F.col("dp") == dp) & (F.col("method") == method) & (F.col("post") == post))
    return rows if eps is None else rows.where(F.col("eps") == (0.0 if dp == "none" else float(eps)))


def within_budget(df: DataFrame, most: float) -> DataFrame:
    """Rows of a budget up to `most`; those without a mechanism have none to compare."""
    return df.where((F.col("dp") == "none") | (F.col("eps") <= most))


def heatmap_sets(df: DataFrame, column: str = "dataset", most_k: int = 32, most_d: int = 512) -> DataFrame:
    """Rows of scale sets (Synth..._k_d_replicate) within the map, with their k and d."""
    part = F.split(F.col(column), "_")
    number = lambda i: F.get(part, F.lit(i)).try_cast("int")
    rows = df.where(F.col(column).startswith("Synth") & (F.size(part) == 4)).withColumns({"k": number(1), "d": number(2)})
    return rows.where((F.col("k") <= most_k) & (F.col("d") <= most_d))


def accepted(df: DataFrame, names: Sequence[str], column: str = "dataset") -> DataFrame:
    return df.where(F.col(column).isin(list(names)))


def matching_average(df: DataFrame, x: str, value: str, prefix: str = "", suffix: str = "", column: str = "dataset") -> DataFrame:
    """Mean by x over data sets whose name begins and ends so; null at an x that only others have."""
    own = F.col(column).startswith(prefix) & F.col(column).endswith(suffix)
    return df.groupBy(x).agg(F.avg(F.when(own & ~F.isnan(value), F.col(value))).alias(value))


def timing_text(elapsed: Column, half: Column, iters: Column) -> Column:
    """Milliseconds a round and half their interval as text of a table, to two decimals without a last zero."""
    number = lambda c: F.regexp_replace(F.format_string("%.2f", ms_per_iteration(c, iters)), "0$", "")
    return F.concat(F.lit("$"), number(elapsed), F.lit(" \\pm "), number(half), F.lit("$"))


def ms_per_iteration(elapsed: Column, iters: Column) -> Column:
    return F.round(elapsed / iters * 1000, 2)


def timing_table(runs: DataFrame, lan: float = 0.000125, wan: float = 0.025) -> DataFrame:
    """dataset, n, k, d, milliseconds a round on either network, and bytes a round (of all ranks)."""
    ms = lambda delay, name: F.round(F.max(F.when(F.abs(F.col("delay") - delay) < 1e-9, F.col("elapsed") / F.col("iters") * 1000)), 2).alias(name)
    out = runs.groupBy("dataset", "n", "k", "d").agg(ms(lan, "lan_ms"), ms(wan, "wan_ms"), F.floor(F.sum(F.when(F.abs(F.col("delay") - lan) < 1e-9, F.col("comm_size") / F.col("iters")))).cast("bigint").alias("comm_bytes"))
    return out.orderBy("n", "k", "d")


#: fixed values: (method, dp, post) -> name in tables
LABELS = {("none", "none", "none"): "Lloyd", ("none", "laplace", "none"): "SuLloyd", ("none", "gaussiananalytic", "none"): "GLloyd", ("diagonal_then_frac", "gaussiananalytic", "fold"): "Flagship"}


def label(method: Column, dp: Column, post: Column) -> Column:
    out = F.lit(None).cast("string")
    for (m, d, p), name in LABELS.items():
        out = F.when((method == m) & (dp == d) & (post == p), name).otherwise(out)
    return out


def protocol_summary(local: DataFrame, ortho: DataFrame, value: str = "nicv") -> DataFrame:
    """Best row of each data set and configuration, with the projection clusterer's rows under their own labels."""
    a = best_by(local, ["dataset", "method", "dp", "post"], value, ["eps"]).select("dataset", label(F.col("method"), F.col("dp"), F.col("post")).alias("label"), value).where("label is not null")
    b = best_by(ortho, ["dataset", "sigma"], value, ["d_prime"]).select("dataset", F.when(F.coalesce("sigma", F.lit(0.0)) == 0, "Ortho").otherwise("Ortho-DP").alias("label"), value)
    return a.unionByName(b)


def basis_summary(df: DataFrame, sigma: float | None = None) -> DataFrame:
    """Best row by NICV of each data set, basis and d'; bases without privacy have one row."""
    return best_by(sigma_filter(df, sigma), ["dataset", "basis_method", "d_prime"], "nicv", ["basis_epsilon"])


def latex(rows: Sequence[dict]) -> str:
    """A LaTeX table of a few rows."""
    if not rows:
        return "\\begin{tabular}{}\n\\end{tabular}"
    heads = list(rows[0])
    body = " \\\\\n".join(" & ".join(str(r[h]) for h in heads) for r in rows)
    return "\\begin{tabular}{" + "l" * len(heads) + "}\n" + " & ".join(heads) + " \\\\\n\\hline\n" + body + " \\\\\n\\end{tabular}"


def cell(v: float) -> str:
    """Heat-map text: three decimals below 1, else three digits."""
    return f"{v:.3f}" if abs(v) < 1 else f"{v:.3g}"
