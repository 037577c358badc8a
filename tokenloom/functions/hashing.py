"""The usual 32-bit hashes of byte strings and integers, as BIGINT columns in [0, 2**32).

Signed-character variants add byte - 256 for bytes of 128 and more, and stop at
a NUL, as compilers for x86 have it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _codes(data: Column) -> Column:
    """array<bigint> of the bytes."""
    code = F.hex(data.cast("binary"))
    n = F.octet_length(data.cast("binary"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def _signed_until_nul(data: Column) -> Column:
    codes = _codes(data)
    nul = F.array_position(codes, 0)
    kept = F.when(nul > 0, F.slice(codes, F.lit(1), nul.cast("int") - 1)).otherwise(codes)
    return F.transform(kept, lambda c: F.when(c >= 128, c - 256).otherwise(c))


def _low(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def _fold(codes: Column, seed: int, step) -> Column:
    return F.aggregate(codes, F.lit(seed).cast("bigint"), lambda h, c: _low(step(h, c)))


def djb2(data: Column) -> Column:
    return _fold(_signed_until_nul(data), 5381, lambda h, c: h * 33 + c)


def fnv1a(data: Column) -> Column:
    return _fold(_codes(data), 2166136261, lambda h, c: h.bitwiseXOR(c) * 16777619)


def sdbm(data: Column) -> Column:
    return _fold(_signed_until_nul(data), 0, lambda h, c: h * 65599 + c)


def _let(x: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(x), body)[0]


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2**32 without leaving BIGINT."""
    return _let(x, lambda v: _low(v.bitwiseAND(F.lit(0xFFFF)) * c + (F.shiftright(v, 16) * c).bitwiseAND(F.lit(0xFFFF)) * 65536))


def _rotate(x: Column, r: int) -> Column:
    return _let(x, lambda v: _low(F.shiftleft(v, r)).bitwiseOR(F.shiftright(v, 32 - r)))


def _folded(x: Column, r: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, r)))


def _mixed(k: Column) -> Column:
    return _times(_rotate(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def murmur3(data: Column, seed: int = 0) -> Column:
    """MurmurHash3 x86_32."""
    return _let(_codes(data), lambda codes: _murmur3(codes, seed))


def _murmur3(codes: Column, seed: int) -> Column:
    n = F.size(codes)
    at = lambda i: F.coalesce(F.get(codes, i), F.lit(0).cast("bigint"))
    word = lambda i: at(i) + at(i + 1) * 256 + at(i + 2) * 65536 + at(i + 3) * 16777216
    blocks = F.floor(n / 4).cast("int")
    starts = F.when(blocks > 0, F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(starts, F.lit(seed).cast("bigint"), lambda acc, b: _low(_rotate(acc.bitwiseXOR(_mixed(word(b * 4))), 13) * 5 + 0xE6546B64))
    h = _let(h, lambda v: F.when(n % 4 != 0, v.bitwiseXOR(_mixed(word(blocks * 4)))).otherwise(v))
    h = _times(_folded(h.bitwiseXOR(n.cast("bigint")), 16), 0x85EBCA6B)
    return _folded(_times(_folded(h, 13), 0xC2B2AE35), 16)


def _int32(x: Column) -> Column:
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def int_hash(key: Column) -> Column:
    """Two rounds of shift, xor and multiply on a signed 32-bit integer, then shift and xor."""
    k = _int32(key.cast("bigint"))
    for _ in range(2):
        k = _let(k, lambda v: _int32(F.shiftright(v, 16).bitwiseXOR(v) * 0x45D9F3B))
    return _let(k, lambda v: _low(F.shiftright(v, 16).bitwiseXOR(v)))


def cache_hash(key: Column, capacity: int | Column) -> Column:
    return int_hash(key) % capacity


def heap_hash(data: Column, capacity: int | Column) -> Column:
    return djb2(data) % capacity
