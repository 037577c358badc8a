"""SQL names for the operators.

Texts, normalization and hashes are SQL functions that Catalyst inlines. Those
that need a vocabulary are registered with one: decoding as SQL over a constant
array of the tokens' bytes, encoding as Arrow functions on batches.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import merge
from tokenloom.functions import text as X
from tokenloom.sources.vocab import Encoding

M32 = "4294967296L"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(t: str) -> str:
    return f"regexp_extract_all(decode(encode(substring_index({t}, char(0), 1), 'UTF-8'), 'ISO-8859-1'), {_quoted(X.PATTERN)}, 0)"


def _normal(t: str) -> str:
    lower = f"translate(substring_index({t}, char(0), 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    white = _quoted(X.WHITE + "+")
    return f"regexp_replace(regexp_replace(regexp_replace({lower}, {_quoted('^' + X.WHITE + '+')}, ''), {white}, '{X.MARK}'), {_quoted(X.MARK + chr(92) + 'z')}, '')"


def _codes(b: str) -> str:
    return f"CASE WHEN octet_length({b}) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(1, greatest(octet_length({b}), 1)), i -> CAST(conv(hex(substring({b}, i, 1)), 16, 10) AS BIGINT)) END"


def _signed(b: str) -> str:
    """Bytes before a NUL; those of 128 and more are negative."""
    cut = f"transform(array({_codes(b)}), a -> CASE WHEN array_position(a, 0L) > 0 THEN slice(a, 1, CAST(array_position(a, 0L) AS INT) - 1) ELSE a END)[0]"
    return f"transform({cut}, c -> CASE WHEN c >= 128 THEN c - 256 ELSE c END)"


def _fold(codes: str, seed: int, step: str) -> str:
    return f"aggregate({codes}, {seed}L, (h, c) -> pmod({step}, {M32}))"


_numbers = count()


def _let(x: str, body) -> str:
    v = f"v{next(_numbers)}"
    return f"transform(array({x}), {v} -> {body(v)})[0]"


def _times(x: str, c: int) -> str:
    return _let(x, lambda v: f"pmod(({v} & 65535L) * {c}L + ((shiftright({v}, 16) * {c}L) & 65535L) * 65536L, {M32})")


def _rotate(x: str, r: int) -> str:
    return _let(x, lambda v: f"(pmod(shiftleft({v}, {r}), {M32}) | shiftright({v}, {32 - r}))")


def _folded(x: str, r: int) -> str:
    return _let(x, lambda v: f"({v} ^ shiftright({v}, {r}))")


def _mixed(k: str) -> str:
    return _times(_rotate(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def _murmur3(b: str) -> str:
    def of(a: str) -> str:
        word = lambda s: "(" + " + ".join(f"coalesce(get({a}, CAST({s} + {i} AS INT)), 0L) * {256**i}L" for i in range(4)) + ")"
        starts = f"CASE WHEN size({a}) >= 4 THEN sequence(0, greatest(size({a}) div 4 - 1, 0)) ELSE CAST(array() AS ARRAY<BIGINT>) END"
        blocks = f"aggregate({starts}, 0L, (h, s) -> pmod({_rotate(f'(h ^ {_mixed(word('s * 4'))})', 13)} * 5 + {0xE6546B64}L, {M32}))"
        tail = _let(blocks, lambda h: f"CASE WHEN size({a}) % 4 <> 0 THEN {h} ^ {_mixed(word(f'(size({a}) div 4) * 4'))} ELSE {h} END")
        return _folded(_times(_folded(_times(_folded(f"({tail} ^ CAST(size({a}) AS BIGINT))", 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)

    return _let(_codes(b), of)


def _int32(x: str) -> str:
    return f"(pmod({x} + 2147483648L, {M32}) - 2147483648L)"


def _int_hash(k: str) -> str:
    x = _int32(f"CAST({k} AS BIGINT)")
    for _ in range(2):
        x = _let(x, lambda v: _int32(f"(shiftright({v}, 16) ^ {v}) * {0x45D9F3B}L"))
    return _let(x, lambda v: f"pmod(shiftright({v}, 16) ^ {v}, {M32})")


def functions() -> dict[str, tuple[str, str, str]]:
    """Name -> what it takes, what it gives, and its body."""
    djb2 = _fold(_signed("b"), 5381, "h * 33 + c")
    return {
        "loom_pieces": ("t STRING", "ARRAY<STRING>", _pieces("t")),
        "loom_normalize": ("t STRING", "STRING", _normal("t")),
        "loom_djb2": ("b BINARY", "BIGINT", djb2),
        "loom_fnv1a": ("b BINARY", "BIGINT", _fold(_codes("b"), 2166136261, "(h ^ c) * 16777619L")),
        "loom_sdbm": ("b BINARY", "BIGINT", _fold(_signed("b"), 0, "h * 65599 + c")),
        "loom_murmur3": ("b BINARY", "BIGINT", _murmur3("b")),
        "loom_int_hash": ("k BIGINT", "BIGINT", _int_hash("k")),
        "loom_cache_hash": ("k BIGINT, n BIGINT", "BIGINT", f"{_int_hash('k')} % n"),
        "loom_heap_hash": ("b BINARY, n BIGINT", "BIGINT", f"{djb2} % n"),
    }


def decoders(encoding: Encoding) -> dict[str, tuple[str, str, str]]:
    size = max(encoding.decodable, default=-1) + 1
    each = json.dumps([base64.b64encode(encoding.decodable.get(i, b"").decode("latin-1").encode()).decode() for i in range(size)])
    table = f"from_json('{each}', 'array<binary>')"  # a character a byte, as UTF-8
    of = lambda t: f"coalesce(CAST(get({table}, CAST(CASE WHEN pmod(CAST({t} AS BIGINT), {M32}) < {size} THEN pmod(CAST({t} AS BIGINT), {M32}) ELSE -1 END AS INT)) AS STRING), '')"
    return {
        "loom_token_bytes": ("t BIGINT", "BINARY", f"encode({of('t')}, 'ISO-8859-1')"),
        "loom_decode_bytes": ("l ARRAY<INT>", "BINARY", f"encode(array_join(transform(l, t -> {of('t')}), ''), 'ISO-8859-1')"),
        "loom_decode": ("l ARRAY<INT>", "STRING", f"make_valid_utf8(CAST(encode(array_join(transform(l, t -> {of('t')}), ''), 'ISO-8859-1') AS STRING))"),
    }


def _encoders(spark: SparkSession, encoding: Encoding) -> list[str]:
    from tokenloom.operators.encode import PieceCoder

    def batched(work):
        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coder = PieceCoder(encoding)
            for values in batches:
                yield values.map(lambda v: None if v is None else work(coder, v))

        return run

    plain = batched(lambda coder, pieces: [i for p in pieces for i in coder.piece(p.encode("latin-1"))])
    table = encoding.pair_table
    spark.udf.register("loom_encode_pieces", plain)
    spark.udf.register("loom_encode_bytes", batched(lambda coder, data: coder.merged(bytes(data))))
    spark.udf.register("loom_encode_piece", batched(lambda coder, data: coder.piece(bytes(data))))
    spark.udf.register("loom_merge", batched(lambda coder, data: merge.merged_starts(bytes(data), table)))
    return ["loom_encode_pieces", "loom_encode_bytes", "loom_encode_piece", "loom_merge"]


def register(spark: SparkSession, encoding: Encoding | None = None) -> list[str]:
    """Make the functions known to the session, with a vocabulary those that need one; their names."""
    found, names = functions(), []
    if encoding:
        names = _encoders(spark, encoding)
        found |= decoders(encoding)
        found["loom_encode"] = ("t STRING", "ARRAY<INT>", "loom_encode_pieces(loom_pieces(t))")
        found["loom_token_count"] = ("t STRING", "BIGINT", "CAST(size(loom_encode_pieces(loom_pieces(t))) AS BIGINT)")
    for name, (takes, gives, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return names + list(found)
