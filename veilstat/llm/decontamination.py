"""Benchmark decontamination by templates, with DataFrame functions only.

Texts are cut into words and numbers. Numbers, names (capitalised words inside a sentence) and units after a number become typed placeholders, so a question
with other values keeps its template. A word that begins a sentence is a name where it stands as one elsewhere in the text; as that may differ between an item and a document that holds it, texts
have a second version of their template where this matters, and one version that matches is enough. Windows of WIDTH template tokens are hashed and joined with those of the benchmark; where a window has placeholders, the
values in it are held against the item's. A value of the item has to become the same value wherever it stands: windows whose
values break that mapping don't count. A document is contaminated by an item if it has at least SHARE of the item's windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.scratch import Scratch

WIDTH = 8
SHARE = 0.5
LITERALS = 4  # of a full window; shorter windows need half of their tokens literal
LEAST = 4  # tokens of an item that can be looked for
BROADCAST_ROWS = 200_000  # windows of a benchmark that is sent to all executors; a larger one is joined by shuffling

# fixed values: units that may follow a number
UNITS = (
    "km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons tonnes l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent "
    "cents mph kmh kph degrees degree celsius fahrenheit watt watts volt volts joule joules pa hz kb mb gb tb"
).split()

NAME, FIRST = "\ue000", "\ue001"  # before a name; before another capitalised word, while a text is cut up
MARK = r"([\p{Ll}\p{N},;:] )(\p{Lu})"
START = f"(^|[^\\p{{L}}\\p{{M}}'’{NAME}-])(\\p{{Lu}})"
TOKEN = f"[{NAME}{FIRST}]?\\p{{L}}[\\p{{L}}\\p{{M}}'’-]*|[0-9]+(?:[.,][0-9]+)*"


def _windows(rows: DataFrame, key: str, widths: list[int], literals_only: bool) -> DataFrame:
    """(key, version, width, hash, slots) of every window; slots are the values behind its placeholders, typed, or null if it has none.

    Version 0 takes words that begin a sentence for words; where one of them stands as a name elsewhere in the text, version 1 takes those for names.
    """
    rows = rows.select(F.col(key).alias("key"), F.regexp_replace("text", MARK, f"$1{NAME}$2").alias("marked"))
    named = F.contains("marked", F.lit(NAME))
    rows = rows.select("key", named.alias("named"), F.lower(F.when(named, F.regexp_replace("marked", START, f"$1{FIRST}$2")).otherwise(F.col("marked"))).alias("marked"))
    # most texts have neither numbers nor names: their words are their template, and no window has slots
    rows = rows.select("key", "named", (~F.col("marked").rlike(f"[0-9{NAME}]")).alias("plain"), F.regexp_extract_all("marked", F.lit(TOKEN), F.lit(0)).alias("raw"))
    rows = rows.withColumn("names", F.when(F.col("named"), F.array_distinct(F.filter("raw", lambda x: F.substring(x, 1, 1) == NAME))))
    first = lambda x: F.substring(x, 1, 1) == FIRST
    bare = lambda x: F.substring(x, 2, 1 << 30)
    words = F.transform("raw", lambda x: F.when(first(x), bare(x)).otherwise(x))
    names = F.transform("raw", lambda x: F.when(first(x), F.when(F.array_contains("names", F.concat(F.lit(NAME), bare(x))), F.concat(F.lit(NAME), bare(x))).otherwise(bare(x))).otherwise(x))
    rows = rows.select("key", "plain", F.posexplode(F.when(F.col("named"), F.array_distinct(F.array(words, names))).otherwise(F.array("raw"))).alias("version", "raw"))
    units = F.array(*[F.lit(u) for u in UNITS])
    number = lambda x: F.substring(x, 1, 1).between("0", "9")
    typed = F.transform("raw", lambda x, i: F.when(number(x), F.lit("#n")).when(F.substring(x, 1, 1) == NAME, F.lit("#p")).when(
        (i > 0) & (F.char_length(x) <= 10) & number(F.get("raw", i - 1)) & F.array_contains(units, x), F.lit("#u")).otherwise(x))
    rows = rows.select("key", "version", "plain", "raw", F.when(F.col("plain"), F.col("raw")).otherwise(typed).alias("t"))
    rows = rows.withColumn("th", F.transform("t", lambda x: F.xxhash64(x)))
    none = F.lit(None).cast("array<string>")

    def of(width: int):
        hashed = lambda i: F.xxhash64(F.slice("th", i + 1, width)).alias("hash")

        def window(i):
            slots = F.filter(F.transform(F.sequence(i, i + width - 1), lambda j: F.when(F.substring(F.get("t", j), 1, 1) == "#", F.concat(F.get("t", j), F.get("raw", j)))), lambda v: v.isNotNull())
            return F.struct(hashed(i), F.when(F.exists(F.slice("t", i + 1, width), lambda v: F.substring(v, 1, 1) == "#"), slots).otherwise(none).alias("slots"))

        places = F.sequence(F.lit(0), F.size("t") - width)
        easy = F.transform(places, lambda i: F.struct(hashed(i), none.alias("slots")))
        return F.when(F.size("t") < width, F.array()).when(F.col("plain"), easy).otherwise(F.transform(places, window))

    parts = [rows.select("key", "version", F.explode(of(w)).alias("w")).select("key", "version", F.lit(w).alias("width"), "w.*") for w in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if literals_only:
        out = out.where(F.col("width") - F.coalesce(F.size("slots"), F.lit(0)) >= F.least(F.lit(LITERALS), F.ceil(F.col("width") / 2)))
    return out


def _item_widths(benchmark: DataFrame) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.lower(F.regexp_replace("text", MARK, f"$1{NAME}$2")), F.lit(TOKEN), F.lit(0)))
    return benchmark.where("text is not null").select("item_id", "text", F.least(n, F.lit(WIDTH)).alias("item_width")).where(f"item_width >= {LEAST}")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, share, contaminated (true) for each document and item over the threshold.

    Windows are distinct template windows, so repeated passages count once. Items of under LEAST tokens, null texts and empty ones match nothing. Rows of one doc_id are
    one document, rows of a null doc_id too; rows of one item_id are one item. Equal windows in several items count for each of them. Empty tables give no rows; other columns are ignored.
    """
    items = _item_widths(benchmark)
    widths = sorted(r[0] for r in items.select("item_width").distinct().collect()) or [WIDTH]  # at most WIDTH values
    b = _windows(items.select(F.struct("item_id", "item_width").alias("id"), "text"), "id", widths, True).where("width = key.item_width")
    b = b.groupBy(F.col("key.item_id").alias("item_id"), "version", "width", "hash").agg(F.min("slots").alias("want"))
    total = b.groupBy("item_id", "version").agg(F.count("*").alias("n_windows"))
    if b.count() <= BROADCAST_ROWS:
        b = F.broadcast(b)
    d = _windows(docs.where("text is not null").select("doc_id", "text"), "doc_id", widths, False)
    hits = d.drop("version").join(b, ["width", "hash"]).select(F.col("key").alias("doc_id"), "item_id", "version", "width", "hash", "slots", "want").distinct()
    hits = Scratch(docs.sparkSession, "templates").keep(hits, "hits")  # two steps read them; the windows are made once
    # value -> value of each pair of document and item: the commonest image, then the least
    pairs = hits.where("slots is not null and size(slots) = size(want)").select("doc_id", "item_id", "version", F.explode(F.arrays_zip(F.col("want").alias("want"), F.col("slots").alias("slots"))).alias("p"))
    pairs = pairs.groupBy("doc_id", "item_id", "version", F.col("p.want").alias("v"), F.col("p.slots").alias("w")).agg(F.count("*").alias("n"))
    image = pairs.groupBy("doc_id", "item_id", "version", "v").agg(F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("best"))
    image = image.groupBy("doc_id", "item_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("v", "best.w"))).alias("image"))
    fits = F.col("slots").isNull() | F.forall(F.arrays_zip(F.col("want").alias("want"), F.col("slots").alias("slots")), lambda p: F.try_element_at("image", p["want"]).eqNullSafe(p["slots"]))
    h, m = hits.alias("h"), image.alias("m")
    held = h.join(m, F.col("h.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("h.item_id") == F.col("m.item_id")) & (F.col("h.version") == F.col("m.version")), "left").where(fits)
    found = held.groupBy("h.doc_id", "h.item_id", "h.version").agg(F.countDistinct("h.hash").alias("n_matched"))
    out = found.join(total, ["item_id", "version"]).where(F.col("n_matched") >= share * F.col("n_windows"))
    best = F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), (-F.col("version")).alias("version"), "n_windows", "n_matched")).alias("best")  # of the versions
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.n_windows", "best.n_matched", F.round("best.share", 6).alias("share"), F.lit(True).alias("contaminated"))


def op4_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)


def _oracle_part(table: str, key: str) -> str:
    name, first = "chr(57344)", "chr(57345)"
    return f"""
{table}_m AS (SELECT DISTINCT {key} AS key, regexp_replace(text, '([\\p{{Ll}}\\p{{N}},;:] )(\\p{{Lu}})', '\\1' || {name} || '\\2', 'g') AS m FROM {table} WHERE text IS NOT NULL),
{table}_f AS (SELECT key, lower(CASE WHEN contains(m, {name}) THEN regexp_replace(m, '(^|[^\\p{{L}}\\p{{M}}''’' || {name} || '-])(\\p{{Lu}})', '\\1' || {first} || '\\2', 'g') ELSE m END) AS m FROM {table}_m),
{table}_r AS (SELECT key, regexp_extract_all(m, '[' || {name} || {first} || ']?\\p{{L}}[\\p{{L}}\\p{{M}}''’-]*|[0-9]+(?:[.,][0-9]+)*') AS raw FROM {table}_f),
{table}_v AS (SELECT key, list_transform(raw, lambda x: CASE WHEN x[1] = {first} THEN x[2:] ELSE x END) AS words, list_transform(raw, lambda x: CASE WHEN x[1] = {first} THEN CASE WHEN list_contains(raw, {name} || x[2:]) THEN {name} || x[2:] ELSE x[2:] END ELSE x END) AS names FROM {table}_r),
{table}_x AS (SELECT DISTINCT key, 0 AS version, words AS raw FROM {table}_v UNION ALL SELECT DISTINCT key, 1 AS version, names AS raw FROM {table}_v WHERE names <> words),
{table}_t AS (SELECT key, version, raw, list_transform(raw, lambda x, i: CASE WHEN x[1] BETWEEN '0' AND '9' THEN '#n' WHEN x[1] = {name} THEN '#p' WHEN i > 1 AND length(x) <= 10 AND raw[i - 1][1] BETWEEN '0' AND '9' AND list_contains([{_UNITS_SQL}], x) THEN '#u' ELSE x END) AS t FROM {table}_x),
{table}_w AS (SELECT key, version, raw, t, unnest(range(1, len(t) - {WIDTH} + 2)) AS i FROM {table}_t),
{table}_s AS (SELECT DISTINCT key, version, array_to_string(t[i:i + {WIDTH - 1}], ' ') AS w, CASE WHEN contains(array_to_string(t[i:i + {WIDTH - 1}], ' '), '#') THEN list_filter(list_transform(range(i, i + {WIDTH}), lambda j: CASE WHEN t[j][1] = '#' THEN t[j] || raw[j] END), lambda v: v IS NOT NULL) END AS slots FROM {table}_w)"""


#: for benchmarks whose items all have at least WIDTH tokens, as the given one
OP4_SQL = f"""
WITH {_oracle_part('documents', 'doc_id')}, {_oracle_part('benchmark', 'item_id')},
b AS (SELECT key AS item_id, version, w, min(slots) AS want FROM benchmark_s WHERE {WIDTH} - coalesce(len(slots), 0) >= {LITERALS} GROUP BY ALL),
total AS (SELECT item_id, version, count(*) AS n_windows FROM b GROUP BY ALL),
hits AS (SELECT DISTINCT d.key AS doc_id, item_id, b.version, w, slots, want FROM documents_s d JOIN b USING (w)),
pairs AS (SELECT doc_id, item_id, version, unnest(want) AS v, unnest(slots) AS x FROM hits WHERE slots IS NOT NULL),
counted AS (SELECT doc_id, item_id, version, v, x, count(*) AS n FROM pairs GROUP BY ALL),
image AS (SELECT doc_id, item_id, version, v, x FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, version, v ORDER BY n DESC, x) = 1),
slotted AS (SELECT doc_id, item_id, version, w, slots, unnest(want) AS v, unnest(slots) AS x FROM hits WHERE slots IS NOT NULL),
broken AS (SELECT DISTINCT s.doc_id, s.item_id, s.version, s.w, s.slots FROM slotted s JOIN image m ON s.doc_id = m.doc_id AND s.item_id = m.item_id AND s.version = m.version AND s.v = m.v WHERE s.x <> m.x),
held AS (SELECT h.doc_id, h.item_id, h.version, h.w FROM hits h LEFT JOIN broken k ON h.doc_id = k.doc_id AND h.item_id = k.item_id AND h.version = k.version AND h.w = k.w AND h.slots = k.slots WHERE k.w IS NULL),
found AS (SELECT doc_id, item_id, version, count(DISTINCT w) AS n_matched FROM held GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_matched, round(n_matched / n_windows, 6) AS share, true AS contaminated
FROM found JOIN total USING (item_id, version) WHERE n_matched >= {SHARE} * n_windows QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched / n_windows DESC, version) = 1
"""
