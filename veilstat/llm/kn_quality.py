"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are UTF-8 bytes and the longest n-gram is ORDER bytes, so each n-gram is a number and tables need no vocabulary. Documents travel in compressed blocks by a hash of their id. One pass counts the
n-grams of the trusted documents of each block and notes which n-grams the block needs; counts are summed over shards of n-grams, lower orders count
distinct continuations, and discounts come from counts of counts. Each needed n-gram's probability is found by joins of those sharded tables (its
longest seen suffix and the weights of the contexts over it), and a second pass brings them back to the blocks, where documents are scored. Thresholds are quantiles, by language, of trusted documents that the
model has not seen. Everything gathered grows with the corpus and is spread over shards; the driver gets discounts only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.scratch import Scratch

ORDER = 5
BLOCK_BYTES = 32 << 20
SALTS = 16  # blocks that the rows of one id are dealt to
QUANTILE = 0.995


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, n, ids, langs, sizes, data): documents of one block that one batch had, compressed together."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            block = b.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(block[order])) + 1, [len(block)]))
            ids, langs, texts = b.column(1), b.column(2), b.column(3)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if s == e:
                    continue
                rows = pa.array(order[s:e])
                own = [t.as_py() or b"" for t in texts.take(rows)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(block[order[s]])], pa.int64()), pa.array([ids.take(rows).to_pylist()], pa.list_(ids.type)), pa.array([langs.take(rows).to_pylist()], pa.list_(pa.string())),
                    pa.array([list(map(len, own))], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(own))], pa.binary())], names=["block", "ids", "langs", "sizes", "data"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(_block(blocks, _salt()).alias("block"), "doc_id", F.col("lang").cast("string"), F.col("text").cast("string").cast("binary")).mapInArrow(
        run, f"block long, ids array<{kind}>, langs array<string>, sizes array<long>, data binary")


def _block(blocks: int, salt):
    return F.pmod(F.xxhash64("doc_id", salt), F.lit(blocks))


def _salt():
    """Spreads the rows of one id over SALTS blocks by their texts, and rows without an id, which are never trusted, over all."""
    text = F.xxhash64("text")
    return F.when(F.col("doc_id").isNull(), text).otherwise(F.pmod(text, F.lit(SALTS)).cast("long"))


def _grams(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that end on each byte of some texts, with the number of their text; before a text stand zero bytes (a text's own zeros count as ones)."""
    pad, lengths = ORDER - 1, np.array(sizes, np.int64)
    out = np.zeros(len(data) + pad * len(sizes), np.uint8)
    at = np.arange(len(data)) + pad * (np.repeat(np.arange(len(sizes)), lengths) + 1)
    raw = np.frombuffer(data, np.uint8)
    out[at] = np.maximum(raw, 1)
    x = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        x = x << 8 | out[at - (ORDER - 1 - j)]
    return x, np.repeat(np.arange(len(sizes)), lengths), lengths


def _pieces(table: pa.Table):
    """Blobs of a block cut into runs of documents of about 4 MB."""
    unpack = zstandard.ZstdDecompressor()
    for i in range(table.num_rows):
        ids, langs, sizes = (table.column(c)[i].as_py() for c in ("ids", "langs", "sizes"))
        data = unpack.decompress(table.column("data")[i].as_py())
        s, at = 0, 0
        while s < len(ids):
            e, n = s, 0
            while e < len(ids) and (e == s or n + sizes[e] <= 4 << 20):
                n += sizes[e]
                e += 1
            yield ids[s:e], langs[s:e], sizes[s:e], data[at:at + n]
            s, at = e, at + n


def _count(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's needed n-grams, with the times that trusted documents have them."""
    trusted = set(right.column("doc_id").to_pylist())
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for ids, _, sizes, data in _pieces(left):
        x, text, _ = _grams(data, sizes)
        if not len(x):
            continue
        use = np.array([i in trusted for i in ids], bool)[text]
        k, inv = np.unique(x, return_inverse=True)
        c = np.bincount(inv, weights=use, minlength=len(k)).astype(np.int64)
        both, inv = np.unique(np.concatenate((keys, k)), return_inverse=True)
        counts = np.bincount(inv, weights=np.concatenate((counts, c)), minlength=len(both)).astype(np.int64)
        keys = both
    block = left.column("block")[0].as_py() if left.num_rows else 0
    return pa.table({"block": pa.array(np.full(len(keys), block)), "key": pa.array(keys), "n": pa.array(counts)})


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with their length and total log probability."""
    keys, logs = right.column("key").to_numpy(), right.column("logp").to_numpy()
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    ids, langs, sizes, sums = [], [], [], []
    for i, g, z, data in _pieces(left):
        x, text, lengths = _grams(data, z)
        ids += i
        langs += g
        sizes += lengths.tolist()
        sums += (np.bincount(text, weights=logs[np.searchsorted(keys, x)], minlength=len(i)) if len(x) else np.zeros(len(i))).tolist()
    kind = left.schema.field("ids").type.value_type
    return pa.table({"doc_id": pa.array(ids, kind), "lang": pa.array(langs, pa.string()), "n_bytes": pa.array(sizes, pa.int64()), "logp": pa.array(sums, pa.float64())})


def train(counts: DataFrame, scratch: Scratch) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """(probabilities, weights, unseen): tables (key, p) of seen n-grams and (key, g) of contexts by order, and the probability of an unseen byte.

    counts: key and n of n-grams of ORDER bytes. Orders below count distinct bytes before an n-gram.
    """
    grams = {ORDER: scratch.keep(counts.where("n > 0"), f"grams{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        grams[k] = scratch.keep(grams[k + 1].groupBy(suffix.alias("key")).agg(F.count("*").alias("n")), f"grams{k}")
    p, g, unseen = {}, {}, 1 / 256
    for k in range(1, ORDER + 1):
        n1, n2, n3, n4 = (x or 0 for x in grams[k].agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5  # a table without singletons has no estimate of its own
        d = [min(i + 0.0, max(0.05, i - (i + 1) * y * b / a)) if a and b else min(0.5 * i, 1.5) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("key", 8)
        w = grams[k].groupBy(context.alias("context")).agg(F.sum("n").alias("t"), F.sum(off).alias("d"))
        w = scratch.keep(w.select("context", "t", (F.col("d") / F.col("t")).alias("g")), f"weights{k}")
        rows = grams[k].join(w, context == F.col("context"))
        own = (F.col("n") - off) / F.col("t")
        if k == 1:
            first = w.first()
            unseen = (first.g if first else 1.0) / 256
            rows = rows.select("key", (own + F.col("g") / 256).alias("p"))
        else:
            below = p[k - 1].withColumnsRenamed({"key": "suffix", "p": "lower"})
            rows = rows.join(below, F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1) == F.col("suffix")).select("key", (own + F.col("g") * F.col("lower")).alias("p"))
        p[k], g[k] = scratch.keep(rows, f"p{k}"), w.select(F.col("context").alias("key"), "g")
    scratch.drop(*[f"grams{k}" for k in grams])
    return p, g, unseen


def resolve(needed: DataFrame, p: dict[int, DataFrame], g: dict[int, DataFrame], unseen: float) -> DataFrame:
    """(key, logp) of distinct n-grams of ORDER bytes: the longest seen suffix, times the weights of the seen contexts above it."""
    out = needed
    for k in range(ORDER, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        table = p[k].withColumnsRenamed({"key": f"k{k}", "p": f"p{k}"})
        out = out.join(F.broadcast(table) if k <= 2 else table, suffix == F.col(f"k{k}"), "left")  # 2 bytes have 65,536 values at most
        if k > 1:
            over = g[k].withColumnsRenamed({"key": f"c{k}", "g": f"g{k}"})
            out = out.join(F.broadcast(over) if k <= 3 else over, F.shiftright(suffix, 8) == F.col(f"c{k}"), "left")
        out = out.select("key", *[c for c in out.columns if c[0] in "pg" and c[1:].isdigit()])
    value = F.coalesce(F.col("p1"), F.lit(unseen))
    for k in range(2, ORDER + 1):
        value = F.coalesce(F.col(f"p{k}"), F.coalesce(f"g{k}", F.lit(1.0)) * value)
    return out.select("key", F.log(value).alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes and perplexity (of a byte; null for empty texts) of every row, under a model of the rows whose doc_id is in `trusted`."""
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    ids = trusted.select("doc_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ids = ids.select(_block(blocks, F.col("salt")).alias("block"), "doc_id").distinct()
    found = _blocks(docs, blocks).groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_count, "block long, key long, n long")
    found = scratch.keep(found, "found")
    p, g, unseen = train(found.groupBy("key").agg(F.sum("n").alias("n")), scratch)
    probs = scratch.keep(resolve(found.select("key").distinct(), p, g, unseen), "probs")
    back = scratch.keep(found.select("block", "key").join(probs, "key").select("block", "key", F.col("logp").cast("float").alias("logp")), "back")
    scratch.drop("found", "probs", *[f"p{k}" for k in p], *[f"weights{k}" for k in g])
    kind = dict(docs.dtypes)["doc_id"]
    scored = _blocks(docs, blocks).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score, f"doc_id {kind}, lang string, n_bytes long, logp double")
    scored = scratch.keep(scored, "scored")
    scratch.drop("back")
    return scored.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("logp") / F.col("n_bytes"))).alias("perplexity"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and keep of every row of `docs`.

    Trusted documents are those that `labels` gives quality 1; those whose crc32(doc_id) mod 4 is 2 set the thresholds, the others train. A language
    without such documents has the threshold of all languages together; without any labels everything is kept. Empty and null texts have no perplexity and are not kept.
    Repeated rows stay and a document counts as often as it stands there; null ids are never trusted; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    scores = perplexities(docs, good.where(~held), scratch)
    seen = scores.where("perplexity is not null").join(good.where(held), "doc_id")
    cuts = seen.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = seen.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    # one row a language: read from a written table, so that Spark joins it by its size
    cuts = scratch.keep(cuts, "cuts").withColumnRenamed("lang", "cut_lang")
    out = scores.join(cuts, F.col("lang").eqNullSafe(F.col("cut_lang")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"), F.lit(float("inf")))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))


def op8_kn_quality(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
