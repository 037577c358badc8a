"""Operator 7: BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct piece. A sequence of
tokens is the BPE result exactly if each token is the result of its own text
and no merge can fire across any adjacent pair before both sides are complete;
that test runs on all pairs of a batch at once, down the merge trees. Pieces
with a failing pair go through exact merging, a merge of all of them at a time;
very long ones by a heap.

A null text counts as empty, an empty text has no ids, a very long one is encoded
whole, in a slice of its own. Repeated rows get a row each and are encoded alike;
there are no ties. An empty table gives an empty result. Columns other than
``text`` pass through untouched; a column that has the name of the result is
replaced by it. Tokenizer files with another normalizer or pre-tokenizer than
the one covered are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import bpe
from tokenloom.llm import words as W

NEVER = np.int64(1) << 40
#: Widths in letters of the tables in which pieces are merged together; longer ones are merged alone.
WIDTHS = (8, 16, 32, 64)
TABLE_ROWS = 8192


class SpeculativeBpe:
    """Ids of spelled pieces under a tokenizer file's merges."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.vocab.values()) + 1
        self.n = n
        #: By token: its two parts, and the rank of the merge that makes it.
        self.left, self.right, self.made = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        joined = (lambda a, b: a + b)
        makers = np.zeros(n, np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[joined(a, b)]
            self.rank.setdefault((x, y), (r, z))
            makers[z] += 1
            if makers[z] == 1:
                self.left[z], self.right[z], self.made[z] = x, y, r
        pairs = np.array([(x * n + y, r) for (x, y), (r, _) in self.rank.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.ranks = pairs[:, 0], pairs[:, 1]
        #: Merges in the order of their ranks: the pair, and the token it makes.
        ordered = sorted(((r, x * n + y, z) for (x, y), (r, z) in self.rank.items()))
        self.pairs = pd.Index(np.array([key for _, key, _ in ordered], np.int64))
        self.results = np.array([z for _, _, z in ordered], np.int64)
        letters = {ord(t): i for t, i in self.vocab.items() if len(t) == 1}
        last = {ord(t[0]): i for t, i in self.vocab.items() if len(t) == 1 + len(self.suffix) and t.endswith(self.suffix)}
        self.letters = np.full((2, max([*letters, *last, 0]) + 2), -1, np.int64)  # the last place is for all others
        for row, found in enumerate((letters, last)):
            self.letters[row, list(found)] = list(found.values())
        self.sound = self._sound(makers)
        inner: dict[str, int] = {}
        final: dict[str, int] = {}
        for text, i in self.vocab.items():
            if not self.sound[i]:
                continue
            if self.suffix and text.endswith(self.suffix):
                final[text[: -len(self.suffix)]] = i
            else:
                inner[text] = i
        self.inner, self.final = inner, final if self.suffix else inner
        self.longest = max(map(len, [*inner, *final, ""]))
        #: The longest token by its first four letters; others have three at most.
        self.reach: dict[str, int] = {}
        for text in inner:
            if len(text) > 3:
                self.reach[text[:4]] = max(self.reach.get(text[:4], 0), len(text))
        self.checked: dict[int, bool] = {}

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.n + y
        if not len(self.keys):
            return np.full(len(key), NEVER)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def quiet(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank below ``until`` fires across the pairs (a, b) as both sides are built.

        From the complete tokens backwards: the side that was made last is
        opened, so the two nodes at hand are always neighbours at one time. A
        merge across fires if it comes before the merges that use up its left
        node, or no later than the one that uses up its right node.
        """
        x, y = a.copy(), b.copy()
        stop = np.full(len(x), NEVER) if until is None else until
        used_x, used_y = stop.copy(), stop.copy()
        fine = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            r = self.merge_rank(p, q)
            first = np.where(used_y[live] == NEVER, NEVER, used_y[live] + 1) if until is None else np.where(used_y[live] == stop[live], stop[live], used_y[live] + 1)
            bad = (r < used_x[live]) & (r < first)
            fine[live[bad]] = False
            open_left = self.made[p] >= self.made[q]
            done = (self.made[p] < 0) & (self.made[q] < 0)
            goes = live[open_left & ~bad & ~done]
            used_x[goes] = self.made[x[goes]]
            x[goes] = self.right[x[goes]]
            goes = live[~open_left & ~bad & ~done]
            used_y[goes] = self.made[y[goes]]
            y[goes] = self.left[y[goes]]
            live = live[~bad & ~done]
        return fine

    def _sound(self, makers: np.ndarray) -> np.ndarray:
        """Tokens that exact merging gives for their own text, with every part older than the whole."""
        sound = makers <= 1
        made = np.flatnonzero((self.made >= 0) & sound)
        a, b = self.left[made], self.right[made]
        good = (self.made[a] < self.made[made]) & (self.made[b] < self.made[made])
        good &= self.quiet(a, b, self.made[made])
        sound[made] &= good
        for z in made[np.argsort(self.made[made])]:
            if not (sound[self.left[z]] and sound[self.right[z]]):
                sound[z] = False
        return sound

    def propose(self, piece: str) -> list[int] | None:
        """Longest match from the left; None if some part has no token."""
        out, at, n = [], 0, len(piece)
        inner, final, reach, most = self.inner, self.final, self.reach, len(piece) - bool(self.suffix)
        while at < n:
            if n - at <= self.longest and (t := final.get(piece[at:])) is not None:
                out.append(t)
                break
            for end in range(min(most, at + reach.get(piece[at : at + 4], 3)), at, -1):
                if (t := inner.get(piece[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
            else:
                return None
        return out

    def exact(self, piece: str) -> list[int]:
        """Merging by rank, the leftmost of equals first, with a heap over a linked list."""
        symbols = [*piece]
        if symbols:
            symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        after, before = [*range(1, n), -1] if n else [], [*range(-1, n - 1)]
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heap = [(r, i, z, p) for r, z, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, (p, q) = heapq.heappop(heap)
            j = after[i] if ids[i] == p else -1
            if j < 0 or ids[j] != q:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (pair := (ids[k], ids[m])) in self.rank:
                    r, made = self.rank[pair]
                    heapq.heappush(heap, (r, k, made, pair))
        return [t for t in ids if t >= 0]

    def exact_all(self, pieces: list[str]) -> list[list[int]]:
        """Exact merging of many pieces: the merge that comes next in each of them, all at once."""
        out: list[list[int] | None] = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(size)
        own = np.repeat(np.arange(len(pieces)), size)
        ids = self.letters[0][np.minimum(codes, self.letters.shape[1] - 1)]
        some = size > 0
        ids[ends[some] - 1] = self.letters[1][np.minimum(codes[ends[some] - 1], self.letters.shape[1] - 1)]
        plain = (np.bincount(own, weights=ids < 0, minlength=len(pieces)) == 0) & some  # letters without a token go to the other form
        low = 0
        for width in WIDTHS:
            fit = np.flatnonzero(plain & (size > low) & (size <= width))
            low = width
            for begin in range(0, len(fit), TABLE_ROWS):
                rows = fit[begin : begin + TABLE_ROWS]
                table = np.full((len(rows), width), -1, np.int64)
                table[np.arange(width) < size[rows, None]] = ids[W.spans(ends[rows] - size[rows], size[rows])]
                for i, found in zip(rows.tolist(), self._merged(table, size[rows])):
                    out[i] = found
        return [self.exact(p) if found is None else found for p, found in zip(pieces, out)]

    def _places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The places of merges in their order; past the end for pairs that do not merge."""
        found = self.pairs.get_indexer(np.where((x < 0) | (y < 0), -1, x * self.n + y).ravel()).reshape(x.shape)
        return np.where(found < 0, len(self.results), found)

    def _merged(self, table: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Rows of ids, -1 behind them, after all their merges."""
        n, width = table.shape
        done, left = table.copy(), size.copy()
        live, column = np.arange(n), np.arange(width)
        rank = self._places(table[:, :-1], table[:, 1:])
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of equals
            i = np.arange(len(live))
            place = rank[i, at]
            goes = place < len(self.results)
            if not goes.all():
                done[live[~goes]] = table[~goes]
                table, rank, live, at, place = table[goes], rank[goes], live[goes], at[goes], place[goes]
                i = np.arange(len(live))
                if not len(live):
                    break
            table[i, at] = self.results[place]
            table = np.take_along_axis(table, np.minimum(column + (column > at[:, None]), width - 1), axis=1)
            table[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(column[:-1] + (column[:-1] >= at[:, None]), width - 2), axis=1)
            rank[:, -1] = len(self.results)
            left[live] -= 1
            follows = at + 1 < width
            rank[i[follows], np.minimum(at, width - 2)[follows]] = self._places(table[i, at], table[i, np.minimum(at + 1, width - 1)])[follows]
            before = at > 0
            rank[i[before], at[before] - 1] = self._places(table[i[before], at[before] - 1], table[i[before], at[before]])
        lists = done[column < left[:, None]].tolist()
        bounds = np.concatenate(([0], np.cumsum(left))).tolist()
        return [lists[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        guesses = [self.propose(p) for p in pieces]
        pairs = {a * self.n + b for g in guesses if g for a, b in zip(g, g[1:])}
        checked = self.checked
        if len(checked) + len(pairs) > 2 * bpe.CACHE_ENTRIES:
            checked.clear()
        new = np.array([p for p in pairs if p not in checked], np.int64)
        if len(new):
            checked.update(zip(new.tolist(), self.quiet(new // self.n, new % self.n).tolist()))
        n = self.n
        failing = [i for i, g in enumerate(guesses) if g is None or not all([checked[a * n + b] for a, b in zip(g, g[1:])])]
        for i, ids in zip(failing, self.exact_all([pieces[i] for i in failing])):
            guesses[i] = ids
        return guesses


class Codec:
    def __init__(self, source: str):
        tokenizer = bpe.load(source)
        self.chunks = bpe.Chunks(tokenizer, SpeculativeBpe(source).encode_pieces)
        size = max([*tokenizer.get_vocab(with_added_tokens=True).values(), -1]) + 1
        self.texts = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def decode(self, ids: list[int]) -> bytes:
        """Without a decoder section the library puts a space between token texts; unknown ids give none."""
        texts = self.texts
        return b" ".join([texts[i] for i in ids if 0 <= i < len(texts)])


def _appended(df: DataFrame, name: str, kind: str, function) -> DataFrame:
    """``df`` with a column that ``function`` makes from each batch, in place of any of that name."""
    others = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]
    schema = T.StructType([*[df.schema.fields[i] for i in others], *T._parse_datatype_string(f"{name} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, extra in function(batch):
                yield pa.record_batch([*[part.column(i) for i in others], extra], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """``df`` with the ids of a text column."""
    source = bpe.shared(df.sparkSession, tokenizer_path)

    def run(batch):
        codec = bpe.once(("codec", hash(source.value)), lambda: Codec(source.value))
        for part in W.slices(batch, text):
            bounds, found = codec.chunks.encode(part.column(text))
            yield part, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.view("<i4")))

    return _appended(df, ids, "array<int>", run)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer_path: str | None = None) -> DataFrame:
    """``df`` with the text of an id column; a null list gives a null."""
    source = bpe.shared(df.sparkSession, tokenizer_path)

    def run(batch):
        codec = bpe.once(("codec", hash(source.value)), lambda: Codec(source.value))
        yield batch, pa.array([None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()], pa.binary()).cast(pa.string())

    return _appended(df, text, "string", run)


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text that they decode to."""
    source = bpe.shared(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.once(("codec", hash(source.value)), lambda: Codec(source.value))
        sha = hashlib.sha256
        for batch in batches:
            for part in W.slices(batch, "text"):
                bounds, ids = codec.chunks.encode(part.column("text"))
                raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), bounds.tolist()
                coded = [sha(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:])]
                texts = [sha(codec.decode(ids[i:j].tolist())).hexdigest() for i, j in zip(at, at[1:])]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(coded, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
