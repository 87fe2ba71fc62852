"""Exact token counts by a compiled finite-state transducer.

A byte-pair encoding is fixed by its neighbours: a sequence of pieces is the encoding of its text exactly if each two
adjacent pieces are the encoding of theirs. So the last piece of a prefix's encoding is the one piece that ends there and
fits the last piece of the prefix before it. A deterministic automaton over characters is compiled from the pieces: its
states are their prefixes, failure links are resolved into transitions on first use, and each transition has the pieces that end on it, longest first. Next to
the automaton's state the transducer keeps the last pieces of as many prefixes as the longest piece is long, and each step emits the
change in the token count (negative where a longer piece takes earlier ones back). A text is cut into chunks; a chunk's map from the state before it to the state and count after it is kept
as (open head, count between, state of the tail), and maps compose by an associative scan.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 1 << 16
WORDS = 250_000  # words and fits kept in a worker; beyond these they are made anew, counts stay the same
FITS = 1_500_000


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            x = data[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i:i + size]
            i += size


class PieceTransducer:
    """Transducer of a BPE model of the sentencepiece library with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.score: dict[str, float] = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) == 1:
                    self.score[piece[1].decode()] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0])
                elif piece.get(3) in (4, 5):
                    raise ValueError("user-defined and unused pieces are not supported")
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
                    raise ValueError("only identity normalisation with a leading space is supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces over a word's end are not supported")
        self.pieces = list(self.score)
        self.longest = max(map(len, self.pieces))
        self.root: dict = {"": ()}
        for k, p in enumerate(self.pieces):
            node = self.root
            for ch in p:
                node = node.setdefault(ch, {"": ()})
            node[""] = ((len(p), k),)
        self.fail: dict[int, dict] = {}
        level = [(c, self.root, ch) for ch, c in self.root.items() if ch]
        while level:
            below = []
            for node, up, ch in level:
                back = self.fail.get(id(up))
                while back is not None and ch not in back:
                    back = self.fail.get(id(back))
                back = self.root if back is None else back[ch]
                self.fail[id(node)] = back
                below += [(c, node, x) for x, c in node.items() if x]
                node[""] += back[""]
            level = below
        self.fits: dict[int, bool] = {}
        self.start = (self.root, (-1,), (0,))
        self.word = _Counts(self, SPACE)
        self.bare = _Counts(self, "")

    def encode(self, text: str) -> list[str]:
        """The merges one by one: best score, leftmost among equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _fit(self, last: int, piece: int) -> bool:
        want = [self.pieces[piece]] if last < 0 else [self.pieces[last], self.pieces[piece]]
        if len(self.fits) > FITS:
            self.fits.clear()
        known = self.fits[last << 32 | piece] = self.encode("".join(want)) == want
        return known

    def _onward(self, node: dict, ch: str) -> dict:
        """Compiles the transition of `node` on `ch`."""
        back = node
        while back is not None and ch not in back:
            back = self.fail.get(id(back))
        if back is not None:
            node[ch] = back[ch]
            return back[ch]
        return self.root

    def walk(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after `text` and the tokens emitted on the way."""
        node, last, count = state[0], list(state[1]), list(state[2])
        fits, i, done, began = self.fits, len(last), 0, state[2][-1]
        for ch in text:
            node = node.get(ch) or self._onward(node, ch)
            for size, piece in node[""]:
                if size <= i:
                    before = last[i - size]
                    ok = fits.get(before << 32 | piece)
                    if ok if ok is not None else self._fit(before, piece):
                        last.append(piece)
                        count.append(count[i - size] + 1)
                        i += 1
                        break
            else:  # not in any piece: its bytes; nothing merges over it
                done += count[-1] - began + len(ch.encode("utf-8", "surrogatepass"))
                node, last, count, i, began = self.root, [-1], [0], 1, 0
        k = self.longest
        return (node, tuple(last[-k:]), tuple(count[-k:])), done + count[-1] - began

    def chunk_map(self, text: str) -> tuple:
        """(head, count, tail): head runs on from the state before, tail is a state, or None if all is head. `text` has SPACE for spaces."""
        lines = text.split("\n")
        if len(lines) == 1:
            at = self._cut(text, 0)
            if at is None:
                return text, 0, None
            head, rest = text[:at], [(SPACE, text[at:])]
        else:
            head, rest = lines[0], [("", line) for line in lines[1:]]
        count = 0 if len(lines) == 1 else 1
        tail = None
        for k, (kind, line) in enumerate(rest):
            end = k == len(rest) - 1
            count += (k > 0) and len(lines) > 1
            segments = _segments(line, kind)
            if not end:
                count += self._sum(segments)
            else:
                count += self._sum(segments[:-1])
                (prefix, body) = segments[-1]
                tail, more = self.walk(self.start, prefix + body)
                count += more
        return head, count, tail

    @staticmethod
    def _cut(text: str, at: int) -> int | None:
        """The first place where a word has ended."""
        i = at
        while i < len(text) and text[i] == SPACE:
            i += 1
        j = text.find(SPACE, i)
        return None if j < 0 else j

    def _sum(self, segments) -> int:
        return sum((self.word if p == SPACE else self.bare)[b] if p in (SPACE, "") else self.bare[p + b] for p, b in segments)

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None and b[2] is None:
            return a[0] + b[0], 0, None
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, more = self.walk(a[2], b[0])
        return a[0], a[1] + more + b[1], state if b[2] is None else b[2]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(text) <= CHUNK and SPACE not in text and "  " not in text and text[0] != " ":
            lines = text.split("\n")
            total, word, bare = len(lines) - 1, self.word.__getitem__, self.bare.__getitem__
            for k, line in enumerate(lines):
                parts = line.split(" ")
                if k:
                    if parts[0]:
                        total += bare(parts[0])
                    elif len(parts) > 1 and line[0] != " ":
                        raise AssertionError
                    parts = parts[1:]
                total += sum(map(word, parts))
            return total
        whole = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(whole[i:i + CHUNK]) for i in range(0, len(whole), CHUNK)]
        while len(maps) > 1:  # one level of the scan after the other; only the total is wanted
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, _ = maps[0]
        return self.walk(self.start, head)[1] + count


def _segments(line: str, kind: str) -> list[tuple[str, str]]:
    """Words with the spaces before them, as (spaces, rest)."""
    out, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j] == SPACE:
            j += 1
        k = line.find(SPACE, j)
        k = n if k < 0 else k
        out.append((line[i:j], line[j:k]))
        if k == n:
            return out
        i = k


class _Counts(dict):
    """Tokens of a word from the start state, kept once walked."""

    def __init__(self, fst: PieceTransducer, prefix: str):
        super().__init__()
        self.fst, self.prefix = fst, prefix

    def __missing__(self, body: str) -> int:
        count = self.fst.walk(self.fst.start, self.prefix + body)[1]
        if len(self) > WORDS:
            self.clear()
        self[body] = count
        return count


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows stay; extra columns are ignored; an empty table gives no rows. A word of any
    length is walked once. `model` is a file that the tokenizer package has on every executor.
    """

    def run(batches):
        fst = transducer(tokenizer_path(model))
        for b in batches:
            n = [fst.count(t) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
