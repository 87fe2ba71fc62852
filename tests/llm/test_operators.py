"""Each operator against brute force, exact round trips or labels, with nulls, empty and repeated rows, extra columns and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from veilstat.llm import chat_tree, decontamination, kn_quality, line_dedup, mpeg_audio, near_dedup, packing, simhash_index, suffix_dedup, token_fst, toxicity
from veilstat.llm.components import connected_components
from veilstat.llm.scratch import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, fp int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = sentence(rng, 60)
    texts = [None, "", " \n\t", "x", sentence(rng, 40), sentence(rng, 40) + "\n" + shared, shared + "\n" + sentence(rng, 30), shared]
    base = sentence(rng, 80)
    edited = base.split()
    edited[40] = "changed"
    texts += [base, base, " ".join(edited), base.upper(), "a" * 700, "é日本 " * 90, sentence(rng, 3000)]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "clash", 1) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "lost " + shared, "en", "s0", 0, "", 0), (99, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, rows, empty):
    got = simhash_index.simhash_components(docs).collect()
    prints = {(r[0], r[1]): brute_print(r[1]) for r in rows}
    assert sorted(((g.doc_id is None, g.doc_id, g.fp & (1 << 64) - 1) for g in got), key=str) == sorted(((r[0] is None, r[0], prints[r[0], r[1]]) for r in rows), key=str)
    group = {}
    for g in got:
        group.setdefault(g.component_id, set()).add(g.fp & (1 << 64) - 1)
    codes = sorted(set(prints.values()))
    reach = {c: {c} for c in codes}
    for _ in codes:
        for a in codes:
            for b in codes:
                if bin(a ^ b).count("1") <= 4:
                    reach[a] |= reach[b]
    low = {c: min(r[0] for r in rows if r[0] is not None and prints[r[0], r[1]] in reach[c]) for c in codes if any(r[0] is not None and prints[r[0], r[1]] in reach[c] for r in rows)}
    assert {g.fp & (1 << 64) - 1: g.component_id for g in got if g.component_id is not None} == low
    assert simhash_index.simhash_components(empty).count() == 0


def test_simhash_ids(spark):
    """Negative, null and repeated ids, and ids that are no numbers."""
    rows = [(-5, "one two three four five"), (3, "one two three four five"), (-7, "quite alone in here now"), (None, "lost words of no id at all"), (None, "one two three four five"), (3, "one two three four five")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_index.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(-5, -5), (3, -5), (3, -5), (-7, -7), (None, None), (None, -5)], key=str)
    named = spark.createDataFrame([("b", "x y z w v"), ("a", "x y z w v"), ("c", "")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash_index.simhash_components(named).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


@pytest.mark.parametrize("depth,node_rows", [(2, 4096), (2, 40), (0, 40), (1, 20)])
def test_index_loses_no_link(spark, monkeypatch, depth, node_rows):
    """Whole nodes, nodes dealt out by bits, and nodes that dealing leaves crowded."""
    monkeypatch.setattr(simhash_index, "DEPTH", depth)
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(120)]
    for c in codes[:6]:  # crowds, so that nodes are dealt out again and the hierarchy is walked
        codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(60)]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, id long")
    scratch = Scratch(spark, "t")
    got = dict(map(tuple, connected_components(simhash_index.near_links(df, scratch, 4, node_rows), scratch).collect()))
    label = list(range(len(codes)))
    changed = True
    arr = np.array(codes, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None]) <= 4
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(codes))]
        changed, label = new != label, new
    assert [got.get(i, i) for i in range(len(codes))] == label


def test_tokens(spark, docs, rows, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=token_fst.tokenizer_path())
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_fst.token_counts(docs).collect()}
    n = {t: len(sp.encode(t or "")) for _, t, *_ in rows}
    assert got == {(i, len((t or "").encode()), n[t], n[t] > 4096) for i, t, *_ in rows}
    assert token_fst.token_counts(empty).count() == 0
    fst, rng = token_fst.transducer(token_fst.tokenizer_path()), random.Random(1)
    bits = ["a", "b", "e", "the", " ", "  ", "\n", "▁", "é", "日本", "😀", "</s>", "<s>", "\t", "ing", "1", "\0", "lo", "wo", "ß"]
    for k in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        assert fst.count(t) == len(sp.encode(t))
        if len(t) > 5:  # chunk maps compose to the same count, wherever a text is cut
            whole = "▁" + t.replace(" ", "▁")
            maps = [fst.chunk_map(whole[i:i + 5]) for i in range(0, len(whole), 5)]
            left = maps[0]
            for m in maps[1:]:
                left = fst.compose(left, m)
            right = maps[-1]
            for m in maps[-2::-1]:
                right = fst.compose(m, right)
            assert fst.walk(fst.start, left[0])[1] + left[1] == fst.walk(fst.start, right[0])[1] + right[1] == fst.count(t)


def test_repeats(spark, docs, rows, empty, monkeypatch):
    count, texts = collections.Counter(), [(t or "").encode() for _, t, *_ in rows]
    for b in texts:
        count.update(b[i:i + 200] for i in range(len(b) - 199))
    want = []
    for (i, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest(), kept))
    for group in (2048, 1):  # groups sorted in one task, and those counted by an aggregation
        monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group)
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_a_text_with_many_phrases(spark):
    """Of equal bytes each is a phrase: those from number 2^20 on count as well."""
    n = (1 << 20) + 5000
    texts = ["a" * n, "b" * 199 + "a" * 300, "c" * 150]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (n, n, 1, b""), 1: (499, 300, 1, b"b" * 199), 2: (150, 0, 0, b"c" * 150)}


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        m = rng.randint(0, 14)
        assert line_dedup.edit_distance(a, b, m) == min(edits(a, b), m + 1)
    pairs = []
    for _ in range(700):
        a = "".join(rng.choice("abc é日") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 300])))
        b = "".join(c if rng.random() < 0.8 else rng.choice(["", "x", c + "y"]) for c in a) if rng.random() < 0.8 else a[::-1]
        pairs.append((a, b))
    got = line_dedup.distances(pairs)
    assert got.tolist() == [line_dedup.edit_distance(a, b, 10**6) for a, b in pairs]
    assert all(line_dedup.words_apart(a.split(" "), b.split(" ")) >= d for (a, b), d in zip(pairs, got))


def test_edit_distance_between_anchors(monkeypatch):
    """Of long lines the distance is never less than the true one, and equal where edits stand apart."""
    rng = random.Random(5)
    monkeypatch.setattr(line_dedup, "LONG", 64)
    for _ in range(30):
        a = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120)]
        b = list(a)
        for k in rng.sample(range(120), rng.randint(0, 8)):
            b[k] = rng.choice(["", "zzzz", b[k] + "x"])
        a, b = " ".join(a), " ".join(b)
        got, true = line_dedup.edit_distance(a, b, len(a)), edits(a, b)
        assert true <= got <= true + 0.2 * len(a)
    a = "".join(rng.choice("ab cd") for _ in range(3000))
    assert line_dedup.edit_distance(a, a, 0) == 0 and line_dedup.edit_distance(a, a[::-1], 600) == 601


def normalised(text):
    return [v.decode() for v in line_dedup.Lines([text.encode()]).normalised().to_pylist()]


def brute_lines(rows, min_chars=24):
    """Groups of all lines: equal ones, and from `min_chars` characters on those of an edit similarity of 0.8, over all pairs. -> rows that dedup_lines should give"""
    place = []
    for i, t, *_ in rows:
        if t is not None:
            place += [((i is None, i or 0, t), k, v) for k, v in enumerate(normalised(t)) if v]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    norms = sorted({v for _, _, v in place})
    for a in norms:
        for b in norms:
            n = max(len(a), len(b))
            if a < b and min(len(a), len(b)) >= max(min_chars, 0.8 * n) and line_dedup.edit_distance(a, b, n) <= 0.2 * n + 1e-9:
                up[find(a)] = find(b)
    best = {}
    for p, k, v in place:
        best[find(v)] = min(best.get(find(v), (p, k)), (p, k))
    stay, want = set(best.values()), collections.Counter()
    for i, t, *_ in rows:
        if t is None:
            want[i, None, 0, 0] += 1
            continue
        lines, norm = t.split("\n"), normalised(t)
        keep = [v for k, v in enumerate(lines) if not norm[k] or ((i is None, i or 0, t), k) in stay]
        want[i, "\n".join(keep), len(lines), len(lines) - len(keep)] += 1
    return want


@pytest.mark.parametrize("set_rows", [2048, 2, 1])
def test_lines(spark, docs, rows, empty, monkeypatch, set_rows):
    """All in one task, crowded blocks dealt out by two blocks, and those by length and parts."""
    monkeypatch.setattr(line_dedup, "SET_ROWS", set_rows)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    got = collections.Counter((r.doc_id, r.text, r.n_lines_, r.n_dropped_) for r in got.collect())
    assert got == brute_lines(rows)
    if set_rows == 2048:
        assert line_dedup.dedup_lines(empty).count() == 0
        clash = line_dedup.dedup_lines(docs.withColumn("n_lines_", docs.fp).withColumn("key", docs.fp))
        assert clash.columns[-2:] == ["n_lines__", "n_dropped__"] and clash.count() == len(rows)


def edited_lines(rng, n, edited, pairs):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    out = []
    for _ in range(pairs):
        a = [rng.choice(words) for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(n), edited):
            b[k] = rng.choice(words)
        out += [" ".join(a), " ".join(b)]
    return out


@pytest.mark.parametrize("set_rows", [2048, 2])
def test_lines_recall(spark, set_rows):
    """Links found, of all pairs of a similarity of 0.8 by edit distance alone, for lines of 8 to 300 words with 1 to 10 % of them replaced."""
    rng, of = random.Random(14), {}
    for n, edited in ((8, 1), (10, 1), (20, 1), (20, 2), (50, 1), (50, 5), (300, 30)):
        lines = edited_lines(rng, n, edited, 60)
        near = {k for k in range(0, len(lines), 2) if line_dedup.similar([(lines[k], lines[k + 1])], 0.8)[0]}
        of[n, edited] = {hash_of(lines[k]): hash_of(lines[k + 1]) for k in near}, lines
    lines = [x for _, v in of.values() for x in v]
    table = spark.createDataFrame([(hash_of(x), x) for x in lines], "line long, norm string")
    root = {r.line: r.root for r in line_dedup.line_links(table, Scratch(spark, "t"), set_rows=set_rows).collect()}
    for kind, (pairs, _) in of.items():
        found = sum(root.get(a, a) == root.get(b, b) for a, b in pairs.items())
        assert len(pairs) >= 40 and found >= 0.9 * len(pairs), (kind, found, len(pairs))


def groups_of(lines):
    """Smallest hash of each line's group, by edit distance over all pairs."""
    up = {x: hash_of(x) for x in lines}
    for k, a in enumerate(lines):
        for b in lines[:k]:
            n = max(len(a), len(b))
            if up[a] != up[b] and min(len(a), len(b)) >= 0.8 * n and line_dedup.edit_distance(a, b, n) <= int(0.2 * n + 1e-9):
                low, high = sorted((up[a], up[b]))
                up = {x: low if v == high else v for x, v in up.items()}
    return {hash_of(x): v for x, v in up.items()}


@pytest.mark.parametrize("rest_rows", [4096, 7])
def test_lines_exact(spark, monkeypatch, rest_rows):
    """Every pair of the similarity is linked: a fifth of the words replaced, or a letter of every word, at and about the edge."""
    monkeypatch.setattr(line_dedup, "REST_ROWS", rest_rows)
    monkeypatch.setattr(line_dedup, "ROUND_CHARS", 1 if rest_rows == 7 else 1 << 25)
    rng, lines = random.Random(21), []
    for n, edited in ((5, 1), (20, 4), (30, 6)):
        lines += [x for x in edited_lines(rng, n, edited, 25) if len(x) >= 24]
    for n in (24, 30, 64, 65, 130, 250):
        for _ in range(6):
            a = "".join(rng.choice("abcdefgh") if k % 5 else " " for k in range(1, n + 1)).strip() + "x"
            at = rng.sample(range(len(a)), int(0.2 * len(a)) + rng.randint(0, 1))
            b = "".join(rng.choice(["", "z", c + "y"]) if k in at else c for k, c in enumerate(a))
            lines += [a, " ".join(b.split())]
    lines = sorted({x for x in lines if len(x) >= 24})
    table = spark.createDataFrame([(hash_of(x), x) for x in lines], "line long, norm string")
    got = {r.line: r.root for r in line_dedup.line_links(table, Scratch(spark, "t")).collect()}
    want = groups_of(lines)
    assert len(lines) - len(set(want.values())) > 60
    assert {x: got.get(x, x) for x in want} == want


def shifted(rng, a, edits):
    """`a` after that many edits: spread, or all insertions or deletions of a stretch, which shift what follows, and back."""
    b, how = list(a), rng.randrange(4)
    at = rng.randrange(len(a) // 2)
    if how == 0:
        for _ in range(edits):
            x = rng.randrange(len(b))
            b[x:x + rng.randrange(2)] = rng.choice(["", "z", "é"])
    elif how == 1:  # a stretch goes from one place to another: a shift of half of the edits between them
        cut, to = edits // 2, rng.randrange(len(a) // 2)
        b = b[:at] + b[at + cut:]
        b[to:to] = ["z"] * cut
    elif how == 2:
        b[at:at] = ["z"] * edits
    else:
        del b[at:at + edits]
    return "".join(b)


@pytest.mark.parametrize("low, high", [(24, 40), (60, 90), (200, 300), (1000, 1300)])
def test_lines_pieces(low, high):
    """Pieces of lines leave out no similar pair, wherever its edits stand, and nearly all that aren't."""
    rng, words = random.Random(low), ["the", "tion", "er", "on", "é", "ing", "a", "sh", "nd", "ou", "st", "ble"]
    base = ["".join(rng.choice([*words, " "]) for _ in range(high))[:rng.randint(low, high)].strip() for _ in range(150)]
    lines = base + [shifted(rng, a, int(0.2 * len(a))) for a in base for _ in range(3)]
    lines = sorted((x for x in lines if x), key=len)
    size = np.array([len(x) for x in lines])
    first, most = np.searchsorted(size, 0.8 * size - 1e-9), (0.2 * size + 1e-9).astype(np.int64)
    for side in (np.full(len(lines), 2), np.arange(len(lines)) % 3):
        got = set()
        for i, j in line_dedup.Texts(lines).meet(side, first, most):
            got |= set(zip(i.tolist(), j.tolist()))
        pairs = [(i, j) for i in range(len(lines)) for j in range(first[i], i) if side[i] > 0 and side[j] != 1]
        some = [p for p in pairs if p not in got]
        assert not line_dedup.similar([(lines[i], lines[j]) for i, j in rng.sample(some, min(len(some), 4000 if high < 1000 else 300))], 0.8).any()
        if 60 <= high < 1000:
            assert len(got) < 0.1 * len(pairs)
    if high < 100:
        near = line_dedup.similar([(lines[i], lines[j]) for i, j in pairs], 0.8)
        assert near.sum() > 50 and {p for p, x in zip(pairs, near) if x} <= got


def test_lines_exact_long(monkeypatch):
    """Neither anchors nor the limit of the batches decide about long lines."""
    monkeypatch.setattr(line_dedup, "LONG", 64)
    rng = random.Random(22)
    a = "".join(rng.choice("abcdefgh") if k % 6 else " " for k in range(1, 400))
    b = "".join("z" if k % 6 == 3 else c for k, c in enumerate(a))  # no stretch of 16 is whole
    d = edits(a, b)
    assert d <= 0.2 * len(a) and line_dedup.anchored_distance(a, b, d) == d + 1
    assert line_dedup.edit_distance(a, b, d) == d and line_dedup.edit_distance(a, b, d - 1) == d
    for wide in (64, 2048):
        monkeypatch.setattr(line_dedup, "WIDE", wide)
        got = line_dedup._rest_of(np.array([5, 9]), np.array([5, 9]), np.array([2, 2]), [a.encode(), b.encode()], 0.8)
        assert got in (([5], [9]), ([9], [5]))


def test_lines_stream():
    """A task of the exact step holds its part and reads the others: its memory doesn't grow with them."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(23)
    words = np.array(["the", "tion", "er", "on", "ing", "a", "sh", "nd", "ou", "st", "ble", " "])
    own = ["".join(rng.choice(words, 180))[:400].strip() for _ in range(60)]

    def batch(side, first, texts):
        n, line = len(texts), np.arange(first, first + len(texts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), pa.array(np.full(n, side, np.int8)), pa.array(line), pa.array(line), pa.array([x.encode() for x in texts])], names=["key", "side", "line", "root", "norm"])

    def batches():
        yield batch(1, 10**6, own)
        for k in range(60):
            texts = ["".join(x)[:360].strip() for x in rng.choice(words, (500, 170))]
            yield batch(0, 500 * k, texts if k < 59 else [*texts[:-1], own[0][:-30]])

    tracemalloc.start()
    got = [x for b in line_dedup._rest(batches(), 0.8) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(10**6, 29999)] and most < 64e6, (got, most)


def hash_of(x):
    return int(line_dedup.Lines([x.encode()]).hash[0])


def test_near_duplicates(spark, docs, rows, empty):
    got = [r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([0, 3, 4, 5, 6, 7, 8, 8, 12, 13, 14], key=str)  # 8 stands twice; its copy, edit and upper-case form go
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_recall(spark):
    """Edited copies of a Jaccard similarity of 0.8, by brute force, against those that go."""
    rng, texts = random.Random(21), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for _ in range(80):
        base = [word(8) for _ in range(35)] + [word(3) for _ in range(15)]
        rng.shuffle(base)
        k = rng.choice([i for i, w in enumerate(base) if len(w) == 8])
        texts += [" ".join(base), " ".join([*base[:k], word(8), *base[k + 1:]])]
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    near = {j for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    gone = set(range(len(texts))) - kept
    assert len(near) == 80 and gone <= near and len(gone) >= 0.9 * len(near)


def test_packing(spark, docs, rows, empty):
    got = packing.pack(docs, capacity=1000, shard_rows=8).collect()
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.n_units
    want = collections.Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").encode())
    assert size == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert sum(r.n_units for r in b) == b[0].bin_units <= 1000
        for keys in ([r.source for r in b if r.source is not None], [r.cluster for r in b if r.cluster is not None]):
            assert len(keys) == len(set(keys))
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs, capacity=50, model="piece_bpe_32k.model").agg({"n_units": "sum"}).first()[0] == token_fst.token_counts(docs).agg({"n_tokens": "sum"}).first()[0]


def test_best_fit_is_tightest():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 60)
        size, src, dup = ([rng.randint(lo, hi) for _ in range(n)] for lo, hi in ((0, 30), (0, 6), (0, 9)))
        got, bins = packing.best_fit(size, src, dup, 30), []
        for i in sorted(range(n), key=lambda i: -size[i]):
            fit = [(30 - sum(size[j] for j in b), k) for k, b in enumerate(bins) if sum(size[j] for j in b) + size[i] <= 30 and all(src[j] != src[i] and dup[j] != dup[i] for j in b)]
            tight = min(fit)[0] if fit else None
            if fit:
                k = got[i]
                assert 30 - sum(size[j] for j in bins[k]) == tight
                bins[k].append(i)
            else:
                assert got[i] == len(bins)
                bins.append([i])


def test_decontamination(spark, empty):
    item = "A train with Maria Lopez aboard leaves at 3 and runs 120 km before 3 more stops while passengers such as Maria Lopez wait for 45 minutes in the rain"
    other = item.replace("120", "777").replace("45", "18").replace("3", "9").replace("Maria Lopez", "Karl Braun")
    broken = item.replace("at 3", "at 5").replace("Maria Lopez aboard", "Karl Braun aboard").replace("120 km before", "120 km after all before")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "one two three four five")], "item_id long, text string")
    rows = [(0, "Intro words here. " + item), (1, "Some lead, " + other + " and more"), (2, broken), (3, "nothing of the sort " * 20), (4, None), (5, ""), (6, "now one two three four five now"), (None, item), (0, "Intro words here. " + item)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (6, 4), (None, 1)}
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Tom has 5 red marbles. Tom buys 7 more marbles at the shop. Tom then gives 3 marbles to Ann. How many marbles does Tom have left?"
    other = item.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "15").replace("7", "8").replace("3", "4")
    rows = [(0, other), (1, item), (2, "The Shop at The Corner, How nice. " + item), (3, item.replace("marbles", "apples").replace("red", "big").replace("shop", "market")), (4, other.replace("gives 4", "takes 15"))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.share for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) >= {0, 1, 2} and 3 not in got and got[0] == got[1] == 1


def test_decontamination_equals_sql(spark, data):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = sorted(map(tuple, decontamination.op4_decontamination(spark, data).collect()))
    assert got == sorted(c.sql(decontamination.OP4_SQL).fetchall()) and got


def test_decontamination_equals_sql_with_names(spark):
    """Texts whose names begin sentences, stand in titles and after other names."""
    rng = random.Random(23)
    names, verbs = ["Tom", "Ann", "Bob", "Mary O'Neil", "Der", "The"], ["sees", "the big house", "buys 3 kg of rice", "gives 12 apples", "and then runs", "at Noon", "in 5 days"]
    say = lambda: ". ".join(f"{rng.choice(names)} {rng.choice(verbs)} {rng.choice(['and', 'with', 'of'])} {rng.choice(names)} {rng.choice(verbs)}" for _ in range(rng.randint(2, 5))) + "."
    items = [(i, say()) for i in range(40)]
    docs = [(i, say() + " " + (rng.choice(items)[1].replace("Tom", "Max").replace("3", "4") if i % 2 else "") + "\n" + say()) for i in range(150)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    c = duckdb.connect()
    for t, df in (("documents", d), ("benchmark", b)):
        c.register(t, df.toPandas())
    got = sorted(map(tuple, decontamination.contaminated(d, b).collect()))
    assert got == sorted(c.sql(decontamination.OP4_SQL).fetchall()) and len(got) > 40


def test_toxicity(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 8 == 0
        t = sentence(rng, 30).split()
        if toxic:
            for w in rng.sample(["scum", "moron", "loser"], 2):
                t.insert(rng.randint(0, len(t)), w)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels[:9] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(d, lab)
    assert {"scum", "moron", "ioser"} <= set(lex.weights) and len(lex.weights) < 6
    extra = spark.createDataFrame([(9001, "such sсum, a M0R0N"), (9002, None), (9003, ""), (9004, "scumble moronic")], "doc_id long, text string")
    got = {r.doc_id: (r.toxicity, r.predicted) for r in toxicity.score(d.union(extra), lex).collect()}
    assert all(got[i][1] == int(i % 8 == 0) for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[9001][1] == 1 and got[9002] == got[9003] == got[9004] == (0.0, 0)
    assert toxicity.fit(empty, lab.limit(0)).weights == {} and toxicity.score(empty, lex).count() == 0
    assert [toxicity.fold(t) for t in ("SCUM!! and", "you scum!", "!!! scum$$$.", "!diot 1d!ot", "m@r$h|")] == ["scum  and", "you scum ", "  scum .", "idiot idiot", "marsh "]
    calm = toxicity.Lexicon({"scum": 9.0}, {("pond", "scum")})
    assert calm.score("pond scum") == 0 < calm.score("scum")


def test_toxicity_learns_stems(spark):
    """A beginning that toxic texts use at a rate, with ever other endings, is one entry; chance uses in long clean texts add nothing."""
    rng = np.random.RandomState(4)
    word = lambda: "".join(rng.choice(list("bdfgkmnprtuvw"), 6))
    ends = [word()[:3] for _ in range(12)]
    rows = []
    for i in range(900):
        ws = [word() for _ in range(60 if i % 6 else 30)]
        if i % 6 == 0:
            ws[::10] = ["gruzzo" + ends[rng.randint(12)] for _ in ws[::10]]
        elif i % 7 == 0:
            ws[30] = "gruzzo" + ends[rng.randint(12)]
        rows.append((i, " ".join(ws), int(i % 6 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lex = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(lex.stems) == 1 and "gruzzo".startswith(next(iter(lex.stems))[:6]) and not any(w.startswith("gruzzo") for w in lex.weights)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lex).collect()}
    assert [got[i] for i, _, _ in rows] == [y for _, _, y in rows]
    many = " ".join([word() for _ in range(5000)] + ["gruzzoabc"] * 2)
    assert lex.score(many) < toxicity.THRESHOLD < lex.score("a gruzzoxyz and gruzzoabc and gruzzodef here") and lex.score("begruzzo begruzzo begruzzo") == 0
    by_hand = sum(max(0.0, 3 * math.log(a / b) - 44 * (a - b)) for a, b in lex.stems.values())
    assert lex.score("a gruzzoxyz and gruzzoabc and gruzzodef here") == pytest.approx(1 - math.exp(-0.15 * by_hand))


def test_toxicity_learns_exceptions(spark):
    """A word that is harmless beside one neighbour in clean texts adds nothing there, and counts elsewhere."""
    rng = random.Random(12)
    rows = []
    for i in range(1200):
        t = sentence(rng, 30).split()
        if i % 4 == 0:
            t.insert(rng.randint(0, 30), "scum")
        elif i % 20 == 1:
            t[rng.randint(0, 28):0] = ["Pond", "scum"]
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    lex = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert lex.exceptions == {("pond", "scum")} and lex.score("clear pond scum here") == 0 < lex.score("you scum")


def test_audio(spark, docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.bad_crc, r.skipped) for r in mpeg_audio.media_features(mpeg_audio.to_media(docs)).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = mpeg_audio.padded(b)
        assert len(p) % 64 == 0 and len(p) >= 64
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), 0, 0] += 1
    assert got == want
    assert mpeg_audio.media_features(mpeg_audio.to_media(empty)).count() == 0


def test_audio_resynchronises():
    rng = np.random.default_rng(0)
    payload = rng.integers(0, 256, 20_000, np.uint8).tobytes()
    data = mpeg_audio.write_audio(payload)
    a = mpeg_audio.read_audio(data)
    assert a.payload == payload and a.table["frames"] == len(a.offsets) == 15 and len(a.table["toc"]) == 100 and a.duration_us == 15 * 36_000
    assert a.seek(0.1) == a.offsets[2] and a.tags["TLEN"] == str(15 * 36)
    cut = int(a.offsets[5])
    b = mpeg_audio.read_audio(data[:cut] + b"\xff\x00junk" * 9 + data[cut:])
    assert b.payload == payload and b.skipped == 54 and (b.offsets[5:] == a.offsets[5:] + 54).all()
    hurt = bytearray(data)
    hurt[int(a.offsets[3]) + 8] ^= 1
    assert mpeg_audio.read_audio(bytes(hurt)).bad_crc == 1
    for x in (b"", b"ID3", b"\xff" * 50, b"no audio at all", data[:cut + 700]):
        mpeg_audio.read_audio(x)


def test_chat(spark):
    rng = random.Random(8)
    said = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [("user", said), ("assistant", said)]}
    for i in range(40):
        head = [("system", f"rules {i % 3}\\n<|"), ("user", "same \\ start\n")]
        convs[i] = head[:rng.randint(1, 2)] + [(rng.choice(["user", "assistant"]), rng.choice(["", "a<|b", "日本\\", "z" * 50])) for _ in range(rng.randint(0, 4))]
    rows = [(c, k, r, t or None, 1) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat_tree.chat_digests(df).collect()}
    want = {}
    for c, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        want[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got == want
    assert chat_tree.chat_digests(df.limit(0)).count() == 0
    # the stream: shared turns once, depth first, intervals of ancestors
    nodes, _ = chat_tree.prefix_tree(chat_tree.formatted_turns(df), Scratch(spark, "t"))
    nodes = {r.node: r for r in nodes.collect()}
    assert len(nodes) == len({tuple(ts[:k + 1]) for ts in convs.values() for k in range(len(ts))})
    spans = sorted((r.start, r.stop) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for r in nodes.values():
        line, at = [], r
        while at is not None:
            line.append((at.start, at.stop))
            at = nodes.get(at.parent)
        assert [tuple(x) for x in r.attend] == line[::-1] and r.position == sum(b - a for a, b in line[1:])
        assert all(a <= r.start for a, _ in line)


def test_quality(spark, empty):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 60) if i % 10 else "".join(chr(rng.randint(33, 126)) for _ in range(300)), "en" if i % 2 else "de") for i in range(1, 300)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i, *_ in rows if i % 3] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "", None), (902, sentence(rng, 60), None), (902, sentence(rng, 60), None), (None, "x", "xx")], "doc_id long, text string, lang string")
    got = kn_quality.quality(docs, labels, 0.99).collect()
    assert len(got) == len(rows) + 5
    keep = {r.doc_id: r.keep for r in got}
    assert sum(keep[i] for i, *_ in rows if i % 10) > 0.95 * 269 and not any(keep[i] for i, *_ in rows if i % 10 == 0)
    assert not keep[900] and not keep[901] and keep[902]
    assert kn_quality.quality(empty, labels).count() == 0


def test_model_sums_to_one(spark):
    """Probabilities of all next bytes add up to 1, in seen contexts and unseen ones."""
    text = b"abracadabra, abracadabra: a bra, a cad; abba."
    x = kn_quality._grams(text, [len(text)])[0]
    keys, n = np.unique(x, return_counts=True)
    p, g, unseen = kn_quality.train(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long"), Scratch(spark, "t"))
    for context in (b"abra", b"zzra", b"zzzz"):
        base = int.from_bytes(context, "big") << 8
        got = kn_quality.resolve(spark.createDataFrame([(base | b,) for b in range(256)], "key long"), p, g, unseen)
        assert sum(np.exp(r.logp) for r in got.collect()) == pytest.approx(1, abs=1e-9)
