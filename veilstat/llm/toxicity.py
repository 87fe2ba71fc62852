"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, maps homoglyphs of other scripts and digit substitutions to the letters they imitate, and puts the
letters that one glyph may stand for (i, l, 1) in one class. A sign stands for a letter within or before a word only: at its end it is punctuation. The lexicon is learned from labelled rows: words whose share of
occurrences in toxic texts is beyond chance by a binomial test over all words seen (Bonferroni) and at least PURITY to 1, weighted by their log odds. A toxic occurrence
counts by text and by pair of neighbours, whichever count is less, so that neither copies of a text nor repetition in one add anything. Exception phrases are pairs of neighbours in which a
lexicon word stands in clean texts, learned likewise (its texts with the pair are clean beyond the word's own share of clean texts, and at least PURITY to 1), plus those given.

Entries are whole words, or stems: beginnings that many words share, none of which makes up half of them, and that toxic texts use at a higher rate than clean ones do by chance. A stem's
occurrences count by their log likelihood ratio less what the text's length makes likely, so that a long clean text doesn't gather a score from them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_TOXIC = 4_000  # labelled rows that a fit reads at most
SAMPLE_CLEAN = 12_000
THRESHOLD = 0.3
PURITY = 4
STEEPNESS = 0.15  # of the score over the sum of weights
STEM = (4, 10)  # letters of a stem
ENDINGS, STEM_TEXTS = 4, 5  # words that a stem has, and toxic texts that it marks, at least

# fixed values: letters of other scripts that look like Latin ones
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "i",
}
# fixed values: digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b"}


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    """Code point -> folded letters, made from Unicode's own decompositions and the two maps above."""
    table = {}
    for cp in (*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c))
        base = "".join(HOMOGLYPHS.get(c, c) for c in base)
        if base != ch:
            table[cp] = "".join(SUBSTITUTES.get(c, c) for c in base)
    for a in range(65, 91):
        table[a] = SUBSTITUTES.get(chr(a + 32), chr(a + 32))
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    table |= {cp: "" for cp in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)}
    return table


# signs that are punctuation: those that no letter or digit follows, and runs of them before a word
_PUNCTUATION = re.compile(r"[!|@$]++(?!\w)|(?<![\w!|@$])[!|@$]{2,}")


def fold(text: str) -> str:
    return _PUNCTUATION.sub(" ", text).translate(fold_table())


_WORDS = re.compile(r"[^\W_]+")


def words(folded: str) -> list[str]:
    return [w for w in _WORDS.findall(folded) if len(w) > 2]


def pairs_at(folded: str, at: int, end: int, w: str) -> list[tuple[str, str]]:
    """The word w, which stands at [at, end], with the word before it and with the word after it."""
    before = _WORDS.findall(folded[max(0, at - 40):at])[-1:]
    after = _WORDS.findall(folded[end + 1:end + 41])[:1]
    return [(v, w) for v in before] + [(w, v) for v in after]


def bounded(folded: str, at: int, end: int, open_end: bool = False) -> bool:
    """Whether [at, end] is a whole word, or with `open_end` how one begins."""
    return not (at and folded[at - 1].isalnum() or not open_end and end + 1 < len(folded) and folded[end + 1].isalnum())


class Lexicon:
    """Weights of folded words, exception phrases (pairs of folded words) and stems with their rates a letter in toxic and in clean texts."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, str]] = frozenset(), stems: dict[str, tuple[float, float]] | None = None):
        self.weights, self.exceptions, self.stems = weights, exceptions, stems or {}
        self.machine = ahocorasick.Automaton()
        for w in {*weights, *self.stems}:
            self.machine.add_word(w, w)
        if len(self.machine):
            self.machine.make_automaton()

    def score(self, text: str) -> float:
        """0 to 1; 0 if nothing matches. Whole words and beginnings of words only; a match inside an exception phrase adds nothing."""
        if not text or not len(self.machine):
            return 0.0
        folded = fold(text)
        total, met = 0.0, {}
        for end, w in self.machine.iter(folded):
            at = end - len(w) + 1
            if w in self.stems and bounded(folded, at, end, True):
                met[w] = met.get(w, 0) + 1
            elif w in self.weights and bounded(folded, at, end) and not (self.exceptions and any(pair in self.exceptions for pair in pairs_at(folded, at, end, w))):
                total += self.weights[w]
        total /= 1 + 0.1 * math.log1p(len(folded) / 6000)
        total += sum(max(0.0, evidence(n, len(folded), *self.stems[w])) for w, n in met.items())
        return 1 - math.exp(-STEEPNESS * total)


def evidence(n: int, length: int, toxic: float, clean: float) -> float:
    """Log likelihood ratio of n occurrences in a text of that length, at either rate."""
    return n * math.log(toxic / clean) - length * (toxic - clean)


def sample_labels(labels: DataFrame, column: str, toxic: int, clean: int) -> DataFrame:
    """At most so many labelled ids of each class, in order of their hashes; rows whose crc32(doc_id) mod 4 is 2 never take part."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("toxic"))
    own = own.where("crc32(cast(doc_id as string)) % 4 <> 2")
    parts = [own.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, toxic), (0, clean))]
    return parts[0].union(parts[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, exceptions=()) -> Lexicon:
    """Learns the lexicon from at most `toxic` and `clean` labelled rows; what the driver gets is the lexicon."""
    pairs = sample_labels(labels, column, toxic, clean)  # bounded by the two parameters, so it can be broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(pairs), "doc_id").select("text", "toxic", F.xxhash64("text").alias("doc"))

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for t, y, d in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(fold(t))
                near = {(w, (ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else "")) for i, w in enumerate(ws)}
                for w, (p, q) in near:
                    out[0].append(w), out[1].append(p), out[2].append(q), out[3].append(y), out[4].append(d)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out[:3]] + [pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())], names=["w", "p", "q", "toxic", "doc"])

    seen = rows.mapInArrow(run, "w string, p string, q string, toxic int, doc long")
    texts = seen.groupBy("w", "doc").agg(F.max("toxic").alias("t")).groupBy("w").agg(F.sum("t").alias("a_texts"), F.sum(1 - F.col("t")).alias("b_texts"))
    # one row for each word and pair of neighbours, whichever texts repeat it
    seen = seen.groupBy("w", F.xxhash64("p", "q").alias("near")).agg(F.max("toxic").alias("t"), F.min("toxic").alias("u"))
    counts = seen.groupBy("w").agg(F.sum("t").alias("a_near"), F.sum(1 - F.col("u")).alias("b_near")).join(texts, "w")
    counts = counts.select("w", F.least("a_near", "a_texts").alias("a"), F.greatest("b_near", "b_texts").alias("b"), "a_near", "b_near")
    from veilstat.llm.scratch import Scratch

    scratch = Scratch(docs.sparkSession, "toxicity")
    counts = scratch.keep(counts, "counts")
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    if not total.v or not total.a or not total.b:
        scratch.drop("counts")
        return Lexicon({})
    q, alpha = total.a / (total.a + total.b), 0.1 / total.v
    found = counts.where((F.col("a") >= 3) & (F.col("a") >= PURITY * F.col("b"))).collect()
    weights = {r.w: math.log((r.a + 0.5) / total.a * total.b / (r.b + 0.5)) for r in found if _tail(r.a, r.a + r.b, q) < alpha}
    stems = _learn_stems(counts, rows, pairs, scratch)
    scratch.drop("counts")
    weights = {w: x for w, x in weights.items() if not any(w.startswith(t) for t in stems)}
    return Lexicon(weights, {tuple(words(fold(e))[:2]) for e in exceptions} | _learn_exceptions(rows, weights, scratch), stems)


def _learn_stems(counts: DataFrame, rows: DataFrame, pairs: DataFrame, scratch) -> dict[str, tuple[float, float]]:
    """Stems with their rates, from the counts of words and the labelled texts (text, toxic, doc).

    Candidates are beginnings whose pairs of neighbours are toxic beyond chance; of these stay those that mark toxic texts beyond chance, and of nested ones the one that separates best.
    """
    whole = counts.agg(F.sum("a_near").alias("a"), F.sum("b_near").alias("b")).first()
    least, most = STEM
    begins = F.transform(F.sequence(F.lit(least), F.least(F.length("w"), F.lit(most))), lambda i: F.substring(F.col("w"), F.lit(1), i))
    open_ = counts.where(F.length("w") >= least).select(F.explode(begins).alias("stem"), "a_near", "b_near").groupBy("stem").agg(
        F.sum("a_near").alias("a"), F.sum("b_near").alias("b"), F.sum((F.col("a_near") > 0).cast("int")).alias("endings"), F.max("a_near").alias("top"))
    open_ = scratch.keep(open_.where((F.col("endings") >= ENDINGS) & (2 * F.col("top") <= F.col("a"))), "stems")
    tested, q = open_.count(), whole.a / (whole.a + whole.b)
    likely = open_.where(F.col("a") * float(whole.b) >= PURITY * F.col("b") * float(whole.a)).collect()
    names = {r.stem for r in likely if _tail(r.a, r.a + r.b, q) < 0.1 / tested}
    scratch.drop("stems")
    if not names:
        return {}

    def run(batches):
        own = Lexicon({}, stems=dict.fromkeys(names, (1.0, 1.0)))
        for b in batches:
            out = set()
            for t, y, d in zip(*(c.to_pylist() for c in b.columns)):
                folded, met = fold(t), {}
                for end, w in own.machine.iter(folded):
                    if bounded(folded, end - len(w) + 1, end, True):
                        met[w] = met.get(w, 0) + 1
                out.update((w, y, d, n, len(folded)) for w, n in met.items())
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["stem", "toxic", "doc", "n", "length"])

    met = rows.mapInArrow(run, "stem string, toxic int, doc long, n long, length long").groupBy("stem", "doc").agg(F.max("toxic").alias("toxic"), F.first("n").alias("n"), F.first("length").alias("length"))
    met = scratch.keep(met, "stems-met")
    side = lambda c, y: F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0))
    # a rate is that of texts that have the stem at all; half an occurrence more keeps it above zero
    rate = lambda y: (side("n", y) + 0.5) / (side("length", y) + 1000)
    rates = scratch.keep(met.groupBy("stem").agg(rate(1).alias("r1"), rate(0).alias("r0")).where("r1 > r0"), "stems-rates")
    cut = -math.log(1 - THRESHOLD) / STEEPNESS
    value = F.col("n") * F.log(F.col("r1") / F.col("r0")) - F.col("length") * (F.col("r1") - F.col("r0"))
    marks = met.join(rates, "stem").withColumn("value", F.greatest(value, F.lit(0.0))).withColumn("marked", (F.col("value") >= cut).cast("int"))
    found = marks.groupBy("stem").agg(side("marked", 1).alias("a"), side("marked", 0).alias("b"), (side("value", 1) - PURITY * side("value", 0)).alias("gain"), F.first("r1").alias("r1"), F.first("r0").alias("r0")).collect()
    scratch.drop("stems-met", "stems-rates")
    sizes = {r.toxic: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    q = sizes[1] / (sizes[1] + sizes[0])
    good = [r for r in found if r.a >= STEM_TEXTS and r.a * (1 - q) >= PURITY * r.b * q and _tail(r.a, r.a + r.b, q) < 0.1 / len(names)]
    stems: dict[str, tuple[float, float]] = {}
    for r in sorted(good, key=lambda r: (-r.gain, -len(r.stem), r.stem)):  # of stems that do alike, the longest
        if not any(r.stem.startswith(t) or t.startswith(r.stem) for t in stems):
            stems[r.stem] = (r.r1, r.r0)
    return stems


def _learn_exceptions(rows: DataFrame, weights: dict[str, float], scratch) -> set[tuple[str, str]]:
    """Pairs of neighbours of a lexicon word that make it harmless, from the labelled texts (text, toxic, doc); copies of a text count once."""
    if not weights:
        return set()

    def run(batches):
        own = Lexicon(weights)
        for b in batches:
            out = set()
            for t, y, d in zip(*(c.to_pylist() for c in b.columns)):
                folded = fold(t)
                for end, w in own.machine.iter(folded):
                    at = end - len(w) + 1
                    if not bounded(folded, at, end):
                        continue
                    out.add((w, None, None, y, d))  # the word itself, whatever stands beside it
                    out.update((w, p, q, y, d) for p, q in pairs_at(folded, at, end, w))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.string()] * 3, pa.int32(), pa.int64()))], names=["w", "p", "q", "toxic", "doc"])

    met = rows.mapInArrow(run, "w string, p string, q string, toxic int, doc long").groupBy("w", "p", "q", "doc").agg(F.max("toxic").alias("t"))
    met = scratch.keep(met.groupBy("w", "p", "q").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")), "met")
    pairs, alone = met.where("p is not null"), met.where("p is null").select("w", F.col("a").alias("word_a"), F.col("b").alias("word_b"))
    tested = pairs.count()
    found = pairs.where((F.col("b") >= 3) & (F.col("b") >= PURITY * F.col("a"))).join(alone, "w").collect()
    scratch.drop("met")
    return {(r.p, r.q) for r in found if _tail(r.b, r.a + r.b, (r.word_b + 0.5) / (r.word_a + r.word_b + 1)) < 0.1 / tested}


def _tail(a: int, n: int, q: float) -> float:
    """P(X >= a) for X binomial (n, q)."""
    term = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(q) + (n - a) * math.log1p(-q)
    total, k = 0.0, a
    while k <= n and term > -745:
        total += math.exp(term)
        term += math.log((n - k) / (k + 1) * q / (1 - q)) if k < n else 0
        k += 1
    return total


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, names: tuple[str, str] = ("toxicity", "predicted")) -> DataFrame:
    """`docs` with two columns of the given names: the score, and 1 from `threshold` on, else 0. Columns that have those names already are replaced; null and empty texts have 0."""
    weights, exceptions, stems = lexicon.weights, lexicon.exceptions, lexicon.stems

    @F.pandas_udf("double")
    def value(texts):
        import pandas as pd

        key = id(weights)
        if _KEPT.get("key") != key:
            _KEPT.update(key=key, lexicon=Lexicon(weights, exceptions, stems), hold=weights)
        own = _KEPT["lexicon"]
        return pd.Series([own.score(t) if t else 0.0 for t in texts], dtype="float64")

    return docs.withColumn(names[0], F.coalesce(value(F.col("text")), F.lit(0.0))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


_KEPT: dict = {}


def op5_toxicity(spark, sf_dir):
    """Every row of documents with its score; ties and repeated rows stay, extra columns are ignored, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), lexicon)
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)")
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), "predicted")
