"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b; BIGINT); root is the smallest node reachable.

    Each round keeps the edge count at or below that of its input, runs as joins and aggregates whose
    map side combines a hub's rows, and is written to the shared folder. Self loops and repeated edges are allowed;
    an edge with a null end is ignored. The driver sees two numbers a round.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, seen = scratch.keep(e, f"{tag}0"), None
    for r in range(1, max_rounds + 1):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.keep(low, f"{tag}{r}l")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{tag}{r}a")
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}{r}s")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.keep(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), f"{tag}{r}")
        # a star forest has one edge for each node that isn't a root, and no root has an edge upwards
        n, s = nxt.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        scratch.drop(f"{tag}{r - 1}", f"{tag}{r}l", f"{tag}{r}a", f"{tag}{r}s")
        cur = nxt
        if (n, s) == seen:
            break
        seen = (n, s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
