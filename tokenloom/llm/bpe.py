"""Word-level BPE shared by the token writer and the encoder.

A text is cut at ASCII white space; each distinct chunk is then cut into the
pieces that the tokenizer's own normalizer and pre-tokenizer give, and each
distinct piece of a slice is encoded once, so the cost follows the distinct
pieces and not the words. Chunks of plain letters and punctuation, nearly all, are
cut by Arrow, which holds for the normalizer and pre-tokenizer in ``COVERED``
alone; files with others are refused.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tokenloom.llm import words as W

#: Entries that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 150_000

#: Letters whose NFC form and lower case are known without Unicode tables, then plain punctuation.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:%*#&$|-]*)$"

# The normalizer and pre-tokenizer for which plain chunks and the cut at white space give the library's pieces.
COVERED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte, as byte-level BPE vocabularies write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def spelled(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


class Chunks:
    """Token ids of chunks. ``encode_pieces`` maps a list of spelled pieces to lists of ids."""

    def __init__(self, tokenizer, encode_pieces: Callable[[list[str]], list[list[int]]]):
        self.tokenizer, self.encode_pieces = tokenizer, encode_pieces
        added = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def cut(self, chunk: str) -> list[str | int]:
        """Spelled pieces, and ids of special tokens, by the tokenizer's own rules."""
        out: list[str | int] = []
        for part in self.at_special.split(chunk) if self.at_special else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def packed(self, pieces: list[str]) -> dict[str, bytes]:
        """The cache, with these spelled pieces in it."""
        have = self.pieces
        new = [p for p in pieces if p not in have]
        if new:
            if len(have) + len(new) > CACHE_ENTRIES:
                have.clear()
                new = list(dict.fromkeys(pieces))
            for p, ids in zip(new, self.encode_pieces(new), strict=True):
                have[p] = array("I", ids).tobytes()
        return have

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of plain letters, or plain punctuation: the place of each among the distinct ones, their ids in turn, and how many each has."""
        coded = pc.utf8_lower(words).dictionary_encode()
        found = self.encode_pieces([w if w.isascii() else spelled(w) for w in coded.dictionary.to_pylist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return coded.indices.to_numpy(), np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def rest(self, chunks: list[str]) -> list[bytes]:
        known = self.chunks
        new = [c for c in chunks if c not in known]
        if new:
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = list(dict.fromkeys(chunks))
            cuts = [self.cut(c) for c in new]
            have = self.packed(list(dict.fromkeys(p for c in cuts for p in c if type(p) is str)))
            for c, parts in zip(new, cuts, strict=True):
                known[c] = b"".join([have[p] if type(p) is str else p.to_bytes(4, "little") for p in parts])
        return [known[c] for c in chunks]

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in turn, and the number of ids of each."""
        found = pc.extract_regex(vocabulary, PLAIN)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        (word, words, n_words), (tail, tails, n_tails) = (self.plain(pc.struct_field(found, k).filter(pa.array(simple))) for k in ("word", "tail"))
        others = self.rest(vocabulary.filter(pa.array(~simple)).to_pylist())
        # each chunk is two spans of one pool; the second is empty for chunks that are not simple
        size = np.concatenate((n_words, n_tails, np.fromiter(map(len, others), np.int64, len(others)) >> 2, [0]))
        pool, start = np.concatenate((words, tails, np.frombuffer(b"".join(others), "<u4"))), np.cumsum(size) - size
        spans = np.full((len(vocabulary), 2), len(size) - 1, np.int64)
        spans[simple, 0], spans[simple, 1] = word, len(n_words) + tail
        spans[~simple, 0] = len(n_words) + len(n_tails) + np.arange(len(others))
        flat = spans.ravel()
        return pool[W.spans(start[flat], size[flat])], size[spans].sum(axis=1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and ids (uint32) of the texts of a column; a null text is empty."""
        w = W.split(column)
        pool, sizes = self.of(w.vocabulary)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[w.codes]
        ids = pool[W.spans(starts[w.codes], lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[w.bounds]
        return bounds, ids


_KEPT: dict = {}


def once(key, make):
    """One object per worker process and key."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def load(source: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def shared(spark: SparkSession, path: str | None):
    """The content of a tokenizer file, sent to the executors; other kinds of files than the one covered are refused."""
    with open(path or default_path(), encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    model = spec["model"]
    if (spec.get("normalizer"), spec.get("pre_tokenizer")) != COVERED:
        raise ValueError("the tokenizer file has another normalizer or pre-tokenizer than the one covered")
    if model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only plain BPE files without decoder and post-processor are covered")
    return spark.sparkContext.broadcast(source)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
