"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

Fingerprints are made in Arrow batches. Equal ones collapse before anything else moves. Two fingerprints that
differ in at most `radius` bits agree on all but `radius` of `radius + 2` blocks, so the index's upper nodes are the masked
patterns of two whole blocks. Below an upper node fingerprints are in Gray order, and a binary hierarchy over that
order holds, for each node, the bits that all its fingerprints share. Pairs of nodes are walked from the top:
differences among shared bits add up, a pair of groups beyond the radius is pruned whole, and one that can't
leave the radius is linked whole. An upper node with too many fingerprints is dealt out again by more of its bits, DEPTH times at most; what
is crowded even then is cut into parts, and each pair of parts is a node of its own, so that no task gets an unbounded group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.components import connected_components
from veilstat.llm.scratch import Scratch

RADIUS = 4
WIDTH = 4  # words in a shingle, as the contract of the fingerprint has it
SHARE = 16
DEPTH = 2
NODE_ROWS = 4096  # an upper node with more distinct fingerprints is dealt out again


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit majority fingerprint of word shingles; 0 if there is no word."""
    words = text.lower().split()  # bytes: only A-Z, and only the six ASCII spaces
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        m = min(8192, n - k)
        hs = [h(joined[a:b], 42) for a, b in zip(starts[k:k + m].tolist(), ends[k + width - 1:k + width - 1 + m].tolist())]
        bits = np.unpackbits(np.array(hs, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, m, 255):
            ones += np.add.reduce(bits[j:j + 255], axis=0, dtype=np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fp (BIGINT with the fingerprint's bits) of every row; null texts count as empty."""

    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of two whole blocks of radius + 2."""
    cut = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def deeper_masks(mask: int, radius: int) -> list[int]:
    """`mask` with one of radius + 1 parts of its free bits: two fingerprints within the radius agree on one of these."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << i for i in free[p::radius + 1]) for p in range(radius + 1)]
    return [mask | p for p in parts if p]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Labels:
    """Smallest label of each linked set, over arrays of links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            if not (open_ := a != b).any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def link_small(codes: np.ndarray, group: np.ndarray, longest: int, labels: _Labels, radius: int) -> None:
    """Links within groups of a few rows: each row against the next ones of its group."""
    for d in range(1, longest):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            return
        near = np.bitwise_count(codes[i] ^ codes[i + d]) <= radius
        labels.link(i[near], i[near] + d)


def link_tree(codes: np.ndarray, labels: _Labels, base: int, radius: int) -> None:
    """Links within one group in Gray order, through its hierarchy of shared bits. labels: of the whole chunk, the group's from `base` on."""
    n = len(codes)
    depth = max(1, (n - 1).bit_length())
    ands, ors = [np.concatenate((codes, np.repeat(codes[-1:], (1 << depth) - n)))], []
    ors.append(ands[0])
    for _ in range(depth):
        ands.append(ands[-1][::2] & ands[-1][1::2])
        ors.append(ors[-1][::2] | ors[-1][1::2])

    def whole() -> list[tuple[np.ndarray, np.ndarray]]:
        leaf = labels.of[base:base + n]
        lo = hi = np.concatenate((leaf, np.repeat(leaf[-1:], (1 << depth) - n)))
        out = [(lo, hi)]
        for _ in range(depth):
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            out.append((lo, hi))
        return out

    spans, stack = whole(), [(depth, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        lo, hi = spans[level]
        keep = (lo[a] != hi[a]) | (lo[b] != hi[b]) | (lo[a] != lo[b])  # else all of both is linked already
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        fixed = ~(ands[level][a] ^ ors[level][a]) & ~(ands[level][b] ^ ors[level][b])
        apart = np.bitwise_count((ands[level][a] ^ ands[level][b]) & fixed).astype(np.int64)
        free = 64 - np.bitwise_count(fixed).astype(np.int64)
        near = apart <= radius
        a, b, sure = a[near], b[near], (apart + free <= radius)[near]
        if sure.any():
            size = 1 << level
            first_a, first_b, run = a[sure] * size, b[sure] * size, np.arange(size)
            xs = np.concatenate((np.repeat(first_a, size), (first_a[:, None] + run).ravel()))
            ys = np.concatenate(((first_b[:, None] + run).ravel(), np.repeat(first_b, size)))
            labels.link(np.minimum(xs, n - 1) + base, np.minimum(ys, n - 1) + base)
            spans = whole()
            a, b = a[~sure], b[~sure]
        if level and len(a):
            same = a == b
            x = np.concatenate((2 * a, 2 * a + 1, 2 * a[~same] + 1, 2 * a))
            y = np.concatenate((2 * b, 2 * b + 1, 2 * b[~same], 2 * b + 1))
            for k in range(0, len(x), 1 << 17):
                stack.append((level - 1, x[k:k + (1 << 17)], y[k:k + (1 << 17)]))


def _links(batches, radius: int):
    """Rows in order of (mask, pattern, Gray rank) -> one link from each row to the smallest id of its linked set."""
    held: pa.Table | None = None

    def solve(t: pa.Table):
        m, p, codes, ids = (t.column(c).to_numpy() for c in ("mask", "pattern", "fp", "id"))
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (p[1:] != p[:-1])))
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(m)))
        codes, labels = codes.view(np.uint64), _Labels(len(m))
        small = sizes[group] <= 48
        idx = np.flatnonzero(small)
        if len(idx):
            own = _Labels(len(idx))
            link_small(codes[idx], group[idx], int(sizes[sizes <= 48].max()), own, radius)
            labels.of[idx] = idx[own.of]
        for s, z in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
            link_tree(codes[s:s + z], labels, s, radius)
        low = np.full(len(m), np.iinfo(np.int64).max)
        np.minimum.at(low, labels.of, ids)
        root = low[labels.of]
        out = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(root[out])], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 1 << 16:
            continue
        m, p = held.column("mask").to_numpy(), held.column("pattern").to_numpy()
        cut = np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1]))
        if len(cut):
            at = int(cut[-1]) + 1
            yield solve(held.slice(0, at))
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield solve(held)


def deal(codes: DataFrame, scratch: Scratch, radius: int, node_rows: int = NODE_ROWS, tag: str = "index") -> DataFrame:
    """The rows of `codes` (fp and any others) under each of their upper nodes (mask, pattern); two rows within `radius` bits share one.

    A node with over `node_rows` rows, as one fingerprint in SHARE tells, is dealt out again by more of its bits, DEPTH times at most, and then over pairs of parts of half `node_rows` (under mask 0).
    The estimate decides where rows go, not which of them meet.
    """

    def placed(df: DataFrame, masks) -> DataFrame:
        return df.withColumn("mask", F.explode(masks)).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))

    def array(masks: list[int]):
        return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])

    level, out = placed(codes, array(block_masks(radius))), []
    for step in range(12):
        told = level.where(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0)
        sizes = told.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(f"n > {node_rows // SHARE}")
        hot = scratch.keep(sizes, f"{tag}-hot{step}")
        masks = [r[0] for r in hot.select("mask").distinct().collect()]  # at most all masks of this level
        deep = {m: deeper_masks(m & (1 << 64) - 1, radius) for m in masks if bin(m & (1 << 64) - 1).count("1") < 64 - radius}
        if not masks:
            out.append(level)
            break
        if step == DEPTH:  # each dealing multiplies a crowd's rows
            deep = {}
        if len(deep) < len(masks):
            last = hot.where(~F.col("mask").isin(list(deep))) if deep else hot
            over = level.join(last, ["mask", "pattern"]).withColumn("parts", F.ceil(F.col("n") * (2 * SHARE / node_rows)).cast("int"))
            over = over.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            pair = F.xxhash64("mask", "pattern", F.least("part", "other"), F.greatest("part", "other"))
            out.append(over.withColumn("pattern", pair).withColumn("mask", F.lit(0).cast("long")).select(level.columns))
        if not deep:
            out.append(level.join(hot, ["mask", "pattern"], "left_anti").select(level.columns))
            break
        if len(deep) < len(masks):
            level = level.join(last, ["mask", "pattern"], "left_anti").select(level.columns)
        hot = hot.where(F.col("mask").isin(list(deep)))
        out.append(level.join(hot, ["mask", "pattern"], "left_anti").select(level.columns))
        child = F.create_map(*[x for m, d in deep.items() for x in (F.lit(m).cast("long"), array(d))])
        over = level.join(hot, ["mask", "pattern"], "left_semi").select(level.columns)
        level = scratch.keep(placed(over, child[F.col("mask")]), f"{tag}-deep{step}")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def near_links(codes: DataFrame, scratch: Scratch, radius: int = RADIUS, node_rows: int = NODE_ROWS, tag: str = "index") -> DataFrame:
    """Links (a, b) that connect all rows of `codes` (fp, id) within `radius` bits of each other; b is the smallest id of a linked set.

    No link is lost: see the module's note.
    """
    gray = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    rows = deal(codes.select("fp", "id"), scratch, radius, node_rows, tag)
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "mask", "pattern").sortWithinPartitions("mask", "pattern", gray)
    return rows.mapInArrow(lambda it: _links(it, radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, text: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs`.

    component_id is the smallest doc_id among the rows linked, directly or through others, at `radius` or fewer differing bits.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay, each with the same values. Rows with a null doc_id
    get a component_id if a linked row has an id, else null. Ids may be negative, or strings (the smallest is the first in order then); other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.keep(fingerprints(docs, text, width), "fp")
    codes = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    links = scratch.keep(near_links(codes.select("fp", F.col("fp").alias("id")), scratch, radius), "links")
    groups = codes.join(connected_components(links, scratch), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = scratch.keep(groups, "groups")
    low = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(groups.join(low, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
