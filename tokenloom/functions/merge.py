"""First-byte merging of a piece's bytes, as a column.

The key of two neighbouring parts is the first byte of each. While some key is a
two-byte token, the one of lowest rank goes, the leftmost of equals, and the
right part joins the left one. Merged parts are not held against the
vocabulary, so a part may be no token at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.sources.vocab import ABSENT, Encoding

#: Bytes up to which a piece is merged inside Spark; the work grows with the square.
SHORT = 64


def first_byte_merge(data: Column, encoding: Encoding) -> Column:
    """array<int> with the starts (from 0) of the parts of a non-empty BINARY."""
    table, code = F.lit(encoding.pair_table), F.hex(data)
    byte = lambda i: F.substring(code, 2 * i + 1, F.lit(2))

    def rank(a: Column, b: Column) -> Column:
        at = F.conv(F.concat(byte(a), byte(b)), 16, 10).cast("int") * 3 + 1
        return F.conv(F.hex(F.substring(table, at, F.lit(3))), 16, 10).cast("int")

    n = F.octet_length(data)
    pairs = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.struct(rank(s[i], s[i + 1]).alias("r"), i.alias("i")))

    def drop(s: Column) -> Column:
        least = F.transform(F.array(F.array_min(pairs(s))), lambda m: F.when(m["r"] == ABSENT, s).otherwise(F.filter(s, lambda v, k: k != m["i"] + 1)))
        return F.when(F.size(s) < 2, s).otherwise(least[0])

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n - 1), lambda s, _: drop(s))


def merged_starts(data: bytes, table: bytes) -> list[int]:
    """The same for one long piece: a heap of neighbours over a linked list."""
    n = len(data)
    after, before, alive = [*range(1, n), n], [*range(-1, n - 1)], bytearray(b"\1" * n)

    def key(i: int) -> int:
        at = 3 * (data[i] * 256 + data[after[i]])
        return int.from_bytes(table[at : at + 3], "big")

    heap = [(r, i, i + 1) for i in range(n - 1) if (r := key(i)) != ABSENT]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j:
            continue
        alive[j] = 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := key(i)) != ABSENT:
                heapq.heappush(heap, (r, i, after[i]))
    return [i for i in range(n) if alive[i]]


def long_merge(encoding: Encoding):
    table = encoding.pair_table

    @F.pandas_udf("array<int>")
    def starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in batches:
            yield data.map(lambda b: None if b is None else merged_starts(b, table))

    return starts


def parts(data: Column, starts: Column) -> Column:
    """array<binary> of the parts with these starts."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.octet_length(data))
    return F.transform(starts, lambda s, k: F.substring(data, s + 1, end(k) - s))
