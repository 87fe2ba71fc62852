"""Conflict-constrained best-fit packing of documents into training sequences.

Lengths are UTF-8 bytes, as byte-level models count them, or exact token counts of a model. Documents are dealt by a hash of their id to shards of about SHARD_ROWS pieces, which fit one task each whatever the input's size;
each shard is packed on its own, longest piece first. Its open bins stand in order of their residual room, and each carries a bitmap of the sources and one of the duplicate clusters in it. The search
starts at the successor of the piece's length and goes on until the tightest bin whose bitmaps are both clear of the piece's.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.scratch import Scratch
from veilstat.llm.token_fst import token_counts

CAPACITY = 16_384
SHARD_ROWS = 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece. A bin holds at most one piece of a source and one of a cluster; None conflicts with nothing. Sizes are at most `capacity`.

    Pieces go longest first (ties in order of input). Sources and clusters of one piece only need no bit.
    """
    def bits(keys: list) -> list[int]:
        count: dict = {}
        for k in keys:
            count[k] = count.get(k, 0) + 1
        place = {k: 1 << i for i, k in enumerate(k for k, n in count.items() if n > 1 and k is not None)}
        return [place.get(k, 0) for k in keys]

    source, cluster = bits(sources), bits(clusters)
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = min(sizes, default=0)
    open_: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # source and cluster bitmap of each bin
    for i in order:
        s, c, need = source[i], cluster[i], sizes[i]
        at = bisect_left(open_, (need, -1))
        while at < len(open_):
            b = held[open_[at][1]]
            if not (b[0] & s or b[1] & c):
                break
            at += 1
        if at < len(open_):
            room, k = open_.pop(at)
            held[k][0] |= s
            held[k][1] |= c
        else:
            room, k = capacity, len(held)
            held.append([s, c])
        out[i] = k
        if room - need >= least:
            insort(open_, (room - need, k))
    return out


def _pack(batches, capacity: int):
    """Rows in order of their shard, each shard's rows together -> pieces with their bins."""
    names = ["doc_id", "source", "cluster", "piece", "first_unit", "n_units", "shard", "bin"]
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table):
        shard = t.column("shard").to_numpy()
        cut = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        size, src, dup = (t.column(c).to_pylist() for c in ("n_units", "source", "cluster"))
        bins = []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            bins += best_fit(size[s:e], src[s:e], dup[s:e], capacity)
        t = t.append_column("bin", pa.array(bins, pa.int64())).select(names)
        return t.to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 4 * SHARD_ROWS:
            continue
        t = pa.Table.from_batches(held)
        k = t.column("shard").to_numpy()
        at = np.flatnonzero(k[1:] != k[:-1])
        if len(at):
            yield from solve(t.slice(0, int(at[-1]) + 1))
            held = t.slice(int(at[-1]) + 1).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield from solve(t)


def cluster_key(text: str = "text"):
    """Texts that are equal but for case and white space are one cluster; empty and null ones are in none."""
    folded = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    return F.when(folded != "", F.xxhash64(folded))


def pack(docs: DataFrame, capacity: int = CAPACITY, source: str = "source", cluster=None, model: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of documents in bins: doc_id, source, cluster, piece, first_unit, n_units, bin_id, bin_units.

    `model` names a tokenizer whose tokens are the units; without it they are bytes. A document longer than `capacity` has several pieces; all but the last fill bins of their own, since a full bin has room for nothing else.
    Empty and null texts have one piece of no units, which fits any bin that its source isn't in. Two rows of one source, or of one duplicate cluster, never share a bin; a null
    source conflicts with nothing. Repeated rows are in one cluster. Null ids are dealt like any other value. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kinds = dict(docs.dtypes)
    key = cluster if cluster is not None else cluster_key()
    if model is None:
        sized = docs.select("doc_id", F.col(source).alias("source"), key.alias("cluster"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_units"))
    else:
        own = docs.select(F.struct("doc_id", F.col(source).alias("source"), key.alias("cluster")).alias("doc_id"), "text")
        sized = token_counts(own, model=model).select("doc_id.*", F.col("n_tokens").alias("n_units"))
    sized = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_units") / capacity).cast("int") - 1, F.lit(0)))))
    sized = sized.withColumn("first_unit", F.col("piece").cast("long") * capacity)
    sized = sized.withColumn("n_units", F.least(F.lit(capacity), F.col("n_units") - F.col("first_unit")).cast("long"))
    sized = scratch.keep(sized, "sized")
    shards = max(1, -(-sized.count() // shard_rows))
    n = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    order = [F.col(c) for c in ("shard", "doc_id", "piece", "cluster", "source")]
    schema = f"doc_id {kinds['doc_id']}, source {kinds[source]}, cluster long, piece int, first_unit long, n_units long, shard long, bin long"
    # each shard is a fixed function of its rows, so a lost task gives the same bins again
    packed = rows.repartition(n, "shard").sortWithinPartitions(*order).mapInArrow(lambda it: _pack(it, capacity), schema)
    packed = packed.withColumn("bin_id", F.col("shard") * (1 << 20) + F.col("bin"))
    packed = scratch.keep(packed, "packed")
    total = packed.groupBy("bin_id").agg(F.sum("n_units").alias("bin_units"))
    return packed.join(total, "bin_id").select("doc_id", "source", "cluster", "piece", "first_unit", "n_units", "bin_id", "bin_units")


def op3_best_fit_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
