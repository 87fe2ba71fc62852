import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
near_dedup = pytest.importorskip("veilstat.llm.near_dedup")
line_dedup = pytest.importorskip("veilstat.llm.line_dedup")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = [set(before)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            rows = out.collect()
            assert all(r.n_chars == len(r.text) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
            kept.append({r.doc_id for r in rows})
            assert kept[-1] <= kept[-2]
            docs = spark.createDataFrame(rows, docs.schema)
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").collect()}
    assert kept[1] >= clean
    last = out.collect()
    assert {r.doc_id for r in last} == kept[4]


def test_toxicity_stage(spark):
    """Of documents with a toxic label more than half go, of clean ones hardly any; the smallest table has too few labels to learn from."""
    data = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{data}/documents.parquet"), data).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    toxic, clean = ({i for i, y in labels.items() if y == v} for v in (1, 0))
    assert len(toxic - kept) > 0.5 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)


def kept_by_brute_force(rows):
    """Documents that stay, over all pairs of texts by five-word shingles."""
    texts = sorted({t or "" for _, t in rows})
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= 0.8 * max(a, b) and (not a or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                up[find(i)] = find(j)
    at, best = {t: k for k, t in enumerate(texts)}, {}
    for i, t in rows:
        g = find(at[t or ""])
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return {i for i, t in rows if best[find(at[t or ""])] == (i is None, i or 0)}


def test_near_stage_equals_brute_force(spark):
    """Of documents that should go nine in ten do at least, and none else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    stay = kept_by_brute_force(rows)
    gone = {i for i, _ in rows} - stay
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()}
    assert got >= stay and len(got - stay) <= 0.1 * len(gone) and gone


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, data, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))

    def put(rows, schema=SCHEMA):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return f"file://{tmp_path}"

    return put


def test_run_on_odd_rows(spark, data, folder):
    """Nulls in every column, empty and repeated rows, ties, a long text, and columns that clash with names of the stages' own."""
    usual = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 40").collect()]
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    lone = [(9001, "a text of its own that nothing else is like, with words enough to be a line"), (9002, "x"), (9003, None), (9004, ""), (9005, None)]
    odd = [(i, t, None, None, None) for i, t in lone]
    odd += [(None, "no id but a text of some length that stays where it is for good", "en", "s", 5), (9010, line, "en", "s", 70), (9011, line, "en", "s", 70), (9012, line.replace("lazy", "sleepy"), "en", None, 70)]
    odd += [(9020, "twin rows have one id and one text, and are one document here", "en", "s", 1)] * 2
    odd += [(9030, "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} of a very long text" for k in range(4000)), "en", "s", 1)]
    schema = SCHEMA + ", key long, line string, n_lines_ int, th string, norm string, toxicity double, predicted int"
    got = corpus_pipeline.run(spark, folder([(*r, 1, "x", 2, "y", "z", 0.5, 1) for r in usual + odd], schema)).collect()
    ids = collections.Counter(r.doc_id for r in got)
    assert {9001, 9002, 9010, None} <= set(ids) and not {9011, 9012} & set(ids)
    assert len({9003, 9004, 9005} & set(ids)) <= 1  # empty texts are copies of each other
    assert set(ids) <= {r[0] for r in usual + odd} and ids[9020] >= 2 and 9030 in ids


def test_run_on_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_line_stage_exact(spark):
    """The line stage drops a line of the similarity of which every word is edited."""
    a = "harbour windows lantern orchard meadows village pottery saddles"
    b = "harbxur winxows lanxern orxhard meaxows vilxage potxery sadxles"
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame([(1, a), (2, b), (3, "a line of its own that no other is like")], "doc_id long, text string").selectExpr("*", "0L as n_chars"), None)
    assert {r.doc_id for r in got.collect()} == {1, 3}
