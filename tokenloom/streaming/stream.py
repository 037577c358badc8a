"""The operators on streams.

Normalization, hashing, pre-tokenization and decoding are columns and run on a
stream as they are. Encoding runs row by row too, with the plan ``rows``; the
plan ``columns`` aggregates, so a stream uses it batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.encode import encode_ordinary
from tokenloom.sources.vocab import Encoding


def encode_stream(stream: DataFrame, encoding: Encoding, text: str = "text", out: str = "tokens") -> DataFrame:
    """A stream with the ids of its texts; stateless."""
    return encode_ordinary(stream, encoding, text, out, plan="rows")


def encode_each_batch(stream: DataFrame, encoding: Encoding, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", out: str = "tokens") -> StreamingQuery:
    """Start a query that encodes every micro-batch with the plan ``columns`` and hands it to ``sink``."""

    def one(batch: DataFrame, number: int) -> None:
        sink(encode_ordinary(batch, encoding, text, out, plan="columns", key=key), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()
