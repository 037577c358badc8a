"""Whole texts of an Arrow batch as word codes, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; one longer text forms a slice alone.
SLICE_BYTES = 6 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of n texts: text i has codes[bounds[i]:bounds[i + 1]], which index ``vocabulary``."""

    bounds: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def nonnull(column: pa.Array) -> pa.Array:
    """A copy with texts for nulls; some Arrow kernels, ascii_lower for one, misread slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def split(column: pa.Array) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D; a null text has none."""
    lists = pc.ascii_split_whitespace(nonnull(column))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    vocabulary = coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:
        full = codes != empty
        bounds = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))[bounds]
        codes = codes[full]
    return Words(bounds, codes, vocabulary)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
