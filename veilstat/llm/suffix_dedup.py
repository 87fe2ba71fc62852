"""Removal of bytes covered by long repeated strings, by prefix-free parsing.

Rolling hashes trigger phrases: each 200-byte window belongs to the leftmost least hash in it, and a run of windows with one trigger,
with the text after it up to a window's length, is a phrase with its lookahead. Equal windows stand in phrases that share their trigger at equal offsets.
Suffix order is needed to the depth of a window only, so it is kept as classes: a phrase that occurs twice settles
all its windows at once (the dictionary); phrases that occur once and share 100 bytes beside the trigger with a different phrase are
where repeats begin and end (the parse), and the suffixes of those phrases alone are ordered. A group of such
phrases is sorted in one task while it has at most GROUP_ROWS occurrences. The phrases of larger groups are cut into intervals of STEP windows: an interval
that recurs is settled whole, and only windows of intervals that share their middle with a different one are counted, by distributed
aggregations. Both are exact, so no group is capped. Classes are compared by 64-bit hashes.

Text identity is a pair of 64-bit hashes, so copies of a text are parsed but compared once. Nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.parsing import Hashed, phrases
from veilstat.llm.scratch import Scratch

WINDOW = 200
GROUP_ROWS = 2048
STEP = 16
PHRASES = 40  # bits of a phrase's number in its partition


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Parse:
    """Phrases of one text, with the hash of each and of the half window left and right of its trigger (and whether a window needs it)."""

    def __init__(self, data: np.ndarray, window: int):
        self.hashed, half = Hashed(data), window // 2
        self.first, self.last, self.at = phrases(self.hashed, window)
        f, l, a = self.first, self.last, self.at
        self.whole = self.hashed.of(f, l + window)
        self.on_left, self.on_right = a - f >= half, a - l < half
        self.left = self.hashed.of(np.where(self.on_left, a - half, 0), np.where(self.on_left, a, 0)) ^ np.uint64(1)
        self.right = self.hashed.of(np.where(self.on_right, a, 0), np.where(self.on_right, a + half, 0))


def _parse_all(batches, window: int):
    rid0 = TaskContext.get().partitionId() << PHRASES
    names = ["kind", "tkey", "rid", "h1", "h2", "whole", "left", "right"]
    for b in batches:
        keep: list[list[np.ndarray]] = [[] for _ in range(6)]
        ids = []
        for i in range(b.num_rows):
            data = _bytes(b.column(0)[i])
            if len(data) < window:
                continue
            p = Parse(data, window)
            rid = rid0 + np.arange(len(p.at))
            ids.append((rid0, i, len(rid)))
            rid0 += len(rid)
            for k, x in enumerate((np.full(len(rid), rid[0]), rid, p.whole, p.left, p.right, p.on_left.astype(np.int8) + 2 * p.on_right.astype(np.int8))):
                keep[k].append(x)
        if not ids:
            continue
        tkey, rid, whole, left, right, on = (np.concatenate(x) for x in keep)
        n = len(rid)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(n, np.int8)), pa.array(tkey), pa.array(rid), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), _signed(whole),
            pa.array(left.view(np.int64), mask=(on & 1) == 0), pa.array(right.view(np.int64), mask=(on & 2) == 0)], names=names)
        rows = pa.array([i for _, i, _ in ids])
        m = len(ids)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(m, np.int8)), *[pa.array([r for r, _, _ in ids], pa.int64())] * 2, b.column(1).take(rows), b.column(2).take(rows),
            pa.array([k for _, _, k in ids], pa.int64()), *[pa.nulls(m, pa.int64())] * 2], names=names)


def _merged(first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that runs of window starts cover, joined where they touch."""
    if not len(first):
        return first, last
    o = np.argsort(first, kind="stable")
    s, e = first[o], np.maximum.accumulate(last[o] + window)
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


# what the first pass knows of a phrase, as bits of a flag
SETTLED, FIRST, LEFT, RIGHT, LEFT_HOT, RIGHT_HOT = 1, 2, 4, 8, 16, 32


def _diverge(batches, window: int):
    """Spans of settled phrases, and the phrases (or in hot groups the windows) where repeats begin and end."""
    names = ["kind", "h1", "h2", "tkey", "key", "rid", "core", "at", "lo", "hi", "settled", "data"]
    done, half = None, window // 2
    for b in batches:
        rows: list[tuple] = []
        for i in range(b.num_rows):
            h1, h2, tkey = (b.column(k)[i].as_py() for k in (1, 2, 3))
            if done == (h1, h2):  # copies of a text follow each other
                continue
            done = (h1, h2)
            data = _bytes(b.column(0)[i])
            p = Parse(data, window)
            flag = np.zeros(len(p.at), np.int64)
            told = b.column(4)[i].values.to_numpy()
            np.bitwise_or.at(flag, told >> 6, told & 63)
            hit = flag & SETTLED > 0
            for s, e in zip(*(x.tolist() for x in _merged(p.first[hit], p.last[hit], window))):
                rows.append((0, h1, h2, tkey, None, None, None, None, s, e, None, None))
            open_ = (flag & (LEFT | RIGHT) > 0) & (~hit | (flag & FIRST > 0))
            for j in np.flatnonzero(open_).tolist():
                f, l, a, g = int(p.first[j]), int(p.last[j]), int(p.at[j]), int(flag[j])
                settled, rid = bool(g & SETTLED), tkey + j
                # offsets of the trigger in the windows: from half a window on they hold the left key, below it the right one
                for use, hot, key, lo, hi in ((g & LEFT, g & LEFT_HOT, p.left[j], max(a - l, half), a - f), (g & RIGHT, g & RIGHT_HOT, p.right[j], a - l, min(a - f, half - 1))):
                    if not use or lo > hi:
                        continue
                    if hot:
                        for j0 in range(lo // STEP, hi // STEP + 1):
                            x0, x1 = max(lo, j0 * STEP), min(hi, j0 * STEP + STEP - 1)
                            ends = np.array([a - x1, a - j0 * STEP]), np.array([a - x0 + window, a - j0 * STEP - STEP + 1 + window])
                            union, core = p.hashed.of(*ends).view(np.int64).tolist()  # of all bytes of its windows; of those that windows at any of its offsets have
                            rows.append((2, h1, h2, tkey, union, rid, core, a, x0, x1, settled, data[a - x1:a - x0 + window].tobytes()))
                    else:
                        rows.append((1, h1, h2, tkey, int(key.view(np.int64)), rid, None, a, lo, hi, settled, data[a - hi:a - lo + window].tobytes()))
            if len(rows) > 4096:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


_TYPES = [pa.int8(), *[pa.int64()] * 6, *[pa.int32()] * 3, pa.bool_(), pa.binary()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=names)


def _order_groups(batches, window: int):
    """Sorts the window suffixes of each group's phrases; yields the window starts that recur, as (h1, h2, lo, hi) runs."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table):
        keys = t.column("key").to_numpy()
        cols = {c: t.column(c).to_numpy() for c in ("h1", "h2", "rid", "at", "lo", "hi")}
        settled, data = np.array(t.column("settled").to_pylist(), bool), t.column("data").to_pylist()
        owner, offset, suffix, group = [], [], [], []
        g = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        seen = set()
        for r in range(len(keys)):
            if (g[r], cols["rid"][r]) in seen:
                continue
            seen.add((g[r], cols["rid"][r]))
            lo, hi = int(cols["lo"][r]), int(cols["hi"][r])
            h = Hashed(np.frombuffer(data[r], np.uint8)).every(window)
            owner.append(np.full(len(h), r)), offset.append(np.arange(hi, lo - 1, -1)), suffix.append(h), group.append(np.full(len(h), g[r]))
        owner, offset, suffix, group = (np.concatenate(x) for x in (owner, offset, suffix, group))
        order = np.lexsort((suffix, offset, group))
        o, x, s, q = owner[order], offset[order], suffix[order], group[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (q[1:] != q[:-1])))
        cls = np.cumsum(new) - 1
        many = np.bincount(cls)[cls] > 1
        many &= ~settled[o]
        o, x = o[many], x[many]
        start = cols["at"][o].astype(np.int64) - x
        order = np.lexsort((start, o))
        o, start = o[order], start[order]
        if not len(o):
            return None
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (start[1:] != start[:-1] + 1)))
        at = np.flatnonzero(new)
        end = start[np.append(at[1:] - 1, len(start) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(cols["h1"][o[at]]), pa.array(cols["h2"][o[at]]), pa.array(start[at].astype(np.int32)), pa.array((end + window).astype(np.int32))], names=["h1", "h2", "lo", "hi"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 2 * GROUP_ROWS:
            continue
        t = pa.Table.from_batches(held)
        k = t.column("key").to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        if len(cut):
            out = solve(t.slice(0, int(cut[-1]) + 1))
            held = t.slice(int(cut[-1]) + 1).to_batches()
            if out is not None:
                yield out
    if held and (t := pa.Table.from_batches(held)).num_rows and (out := solve(t)) is not None:
        yield out


def _windows(batches, window: int):
    """Each window of some intervals, by its trigger's offset and hash."""
    for b in batches:
        if not b.num_rows:
            continue
        hashes = [Hashed(np.frombuffer(d.as_buffer(), np.uint8)).every(window) for d in b.column("data")]
        n = np.array([len(h) for h in hashes])
        row = pa.array(np.repeat(np.arange(b.num_rows), n))
        x = np.repeat(b.column("hi").to_numpy(), n) - np.concatenate([np.arange(k) for k in n])
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in ("h1", "h2", "rid", "at")], pa.array(x.astype(np.int32)), b.column("many").take(row), pa.array(np.concatenate(hashes).view(np.int64))], names=["h1", "h2", "rid", "at", "x", "many", "w"])


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(h1, h2, spans): for each text with bytes to remove, by its two hashes, the merged spans [lo, hi) in order of lo."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    own = own.select(F.col("t").cast("binary").alias("data"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"))
    runs = scratch.keep(own.where(f"octet_length(data) >= {window}").mapInArrow(lambda it: _parse_all(it, window), "kind byte, tkey long, rid long, h1 long, h2 long, whole long, left long, right long"), "runs")
    texts = scratch.keep(runs.where("kind = 1").groupBy("h1", "h2").agg(F.min("tkey").alias("tkey")), "texts")  # copies of a text are one
    runs = runs.where("kind = 0")
    dictionary = scratch.keep(runs.groupBy("whole").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1").select("whole", "first"), "dictionary")
    keys = runs.where("left is not null").select(F.col("left").alias("key"), "whole").unionAll(runs.where("right is not null").select(F.col("right").alias("key"), "whole"))
    mixed = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    mixed = scratch.keep(mixed.select("key", (F.col("n") > GROUP_ROWS).alias("hot")), "mixed")
    flags = runs.select("whole", "tkey", "rid").join(dictionary, "whole").select("tkey", "rid", F.when(F.col("rid") == F.col("first"), SETTLED | FIRST).otherwise(SETTLED).alias("flag"))
    for side, bit, hot in (("left", LEFT, LEFT_HOT), ("right", RIGHT, RIGHT_HOT)):
        flags = flags.unionAll(runs.where(f"{side} is not null").select(F.col(side).alias("key"), "tkey", "rid").join(mixed, "key").select("tkey", "rid", F.when(F.col("hot"), bit | hot).otherwise(bit).alias("flag")))
    flags = flags.join(texts.select("tkey"), "tkey", "left_semi")
    told = flags.groupBy("tkey").agg(F.collect_list((F.shiftleft(F.col("rid") - F.col("tkey"), 6) + F.col("flag")).cast("long")).alias("told"))
    told = scratch.keep(told, "told")
    scratch.drop("runs", "dictionary", "mixed")
    known = scratch.keep(texts.join(told, "tkey").select("h1", "h2", "tkey", "told"), "known")
    scratch.drop("texts", "told")
    parts = own.join(known, ["h1", "h2"]).select("data", "h1", "h2", "tkey", "told").mapInArrow(
        lambda it: _diverge(it, window), "kind byte, h1 long, h2 long, tkey long, key long, rid long, core long, at int, lo int, hi int, settled boolean, data binary")
    parts = scratch.keep(parts, "parts")
    scratch.drop("known")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = parts.where("kind = 0").select("h1", "h2", "lo", "hi")
    cold = parts.where("kind = 1").select("key", "h1", "h2", "rid", "at", "lo", "hi", "settled", "data").repartition(n, "key").sortWithinPartitions("key")
    cold = cold.mapInArrow(lambda it: _order_groups(it, window), "h1 long, h2 long, lo int, hi int")
    hot = parts.where("kind = 2").drop("kind", "tkey").withColumn("j", F.floor(F.col("lo") / STEP))
    place = ["h1", "h2", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + window).alias("hi")]
    again = hot.groupBy("key", "lo", "hi").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.bool_or("settled").alias("s")).where("a <> b or s")
    again = scratch.keep(again.select("key", "lo", "hi", F.col("a").alias("one")), "again")
    whole = hot.where("not settled").join(again, ["key", "lo", "hi"], "left_semi").select(*place)
    # intervals whose middle a different interval has too; of equal ones the first stands for all
    cores = scratch.keep(hot.groupBy("core", "j").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("core", "j"), "cores")
    rest = hot.join(again, ["key", "lo", "hi"], "left").where("one is null or rid = one").withColumn("many", F.col("one").isNotNull() | F.col("settled"))
    rest = rest.join(cores, ["core", "j"], "left_semi").select("h1", "h2", "rid", "at", "hi", "many", "data")
    windows = scratch.keep(rest.mapInArrow(lambda it: _windows(it, window), "h1 long, h2 long, rid long, at int, x int, many boolean, w long"), "windows")
    twice = windows.groupBy("w", "x").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.bool_or("many").alias("s")).where("a <> b or s").select("w", "x")
    twice = scratch.keep(twice, "twice")
    single = windows.where("not many").join(twice, ["w", "x"], "left_semi").select("h1", "h2", (F.col("at") - F.col("x")).alias("lo"), (F.col("at") - F.col("x") + window).alias("hi"))
    hot = whole.unionAll(single)
    spans = settled.unionAll(cold).unionAll(hot).groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    out = scratch.keep(spans, "spans")
    scratch.drop("parts", "again", "cores", "windows", "twice")
    return out


def _cut(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            raw = b.column(1)[i]
            data = raw.as_py() if raw.is_valid else b""
            found = b.column(2)[i]
            merged: list[list[int]] = []
            if found.is_valid:
                lo, hi = (found.values.field(k).to_numpy() for k in (0, 1))
                s, e = _merged(lo.astype(np.int64), hi.astype(np.int64), 0)
                merged = list(zip(s.tolist(), e.tolist()))
            kept, at = [], 0
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=names)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row.

    A byte goes if a `window`-byte string that also starts anywhere else, in this text or another row's, covers it. Null texts are empty. Repeated rows
    count as repeats of each other; extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, scratch, text, window)
    own = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    own = own.select("doc_id", F.col("t").cast("binary").alias("data"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"))
    joined = own.join(spans, ["h1", "h2"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
