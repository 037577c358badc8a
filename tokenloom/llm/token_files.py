"""Operator 3: token ids as Parquet list columns.

``write`` lays documents out in ascending ``doc_id`` order, one file a shard.
Ids are a list column with dictionary pages; ``doc_id``, ``n_tokens`` and
``offset`` are delta-encoded (data page version 2). Row groups and pages have
set sizes, and the writer adds the column and offset indexes, so a reader of a
few ids or of the metadata alone touches only those pages.

Order: a null ``doc_id`` comes first; rows of one id follow each other by text
within a shard. A shard is a range of ids; an id (or null) with more rows than a
shard should have is dealt over several shards by the hash of its texts, and equal
rows of heavy ids by a number (``spreading``). A null text is an empty one; an
empty text still has its end id; a very long one is encoded whole. Repeated rows
are written as often as they come. An empty table gives a folder without rows.
Only ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.search import below
from tokenloom.llm import bpe, scratch, spreading
from tokenloom.llm import words as W

END_ID = 1
NO_ID = -(1 << 63)
SCHEMA = "shard int, doc_id long, n_tokens long, offset long, tokens array<int>"


def _library(source: str) -> bpe.Chunks:
    tokenizer = bpe.load(source)
    model = tokenizer.model
    return bpe.Chunks(tokenizer, lambda pieces: [[t.id for t in model.tokenize(p)] for p in pieces])


def shard_column(docs: DataFrame, shards: int, salt: Column) -> Column:
    """The shard of a row: ranges of ``doc_id`` with about as many rows each, found from that column alone.

    Where several cuts are one id, its rows are dealt over their shards by ``salt``.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    steps = [i / shards for i in range(1, shards)]
    cuts = sorted(docs.select(F.percentile_approx(key, steps, 20 * shards)).first()[0] or []) if steps else []
    array = F.lit(cuts) if cuts else F.array()
    first, last = below(array, len(cuts), key), below(array, len(cuts), key, equal=True)
    return F.when(last > first, first + F.pmod(salt, last - first).cast("int")).otherwise(first)


def write(docs: DataFrame, path: str, shards: int | None = None, tokenizer_path: str | None = None, end_id: int | None = END_ID,
          row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode ``doc_id, text`` and write the files."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = bpe.shared(spark, tokenizer_path)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.once(("library", hash(source.value)), lambda: _library(source.value))
        before: dict[int, int] = {}
        for batch in batches:
            for part in W.slices(batch, "text"):
                bounds, ids = coder.encode(part.column("text"))
                ids = np.insert(ids, np.repeat(bounds[1:], len(tail)), np.tile(tail, len(bounds) - 1))
                bounds = bounds + len(tail) * np.arange(len(bounds))
                counts = np.diff(bounds)
                shard = part.column("shard").to_numpy()
                offset = np.empty(len(counts), np.int64)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    sums = np.cumsum(counts[own]) + before.get(s, 0)
                    offset[own] = sums - counts[own]
                    before[s] = int(sums[-1])
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.record_batch([part.column("shard"), part.column("doc_id"), pa.array(counts), pa.array(offset), tokens], names=["shard", "doc_id", "n_tokens", "offset", "tokens"])

    rows = spreading.numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "number")
    rows = rows.select(shard_column(docs, shards, F.xxhash64("text", "number")).cast("int").alias("shard"), "doc_id", "text")
    (rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
     .mapInArrow(encoded, SCHEMA).write.option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
     .parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files; select and filter what is needed, Parquet's indexes skip the rest."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one row a shard, from the metadata columns alone."""
    totals = read(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for row in sorted(totals):
        out[row.shard] = total
        total += row.n
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    first = starts(spark, path)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            lists = b.column("tokens")
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
            base = np.array([first[s] for s in b.column("shard").to_pylist()], np.int64)
            start = pa.array(base + b.column("offset").to_numpy())
            yield pa.record_batch([b.column("doc_id"), start, b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "token_files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return documents(spark, path)
