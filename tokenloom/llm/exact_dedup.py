"""Operator 8: exact deduplication against a minimal perfect hash.

The digests of earlier documents form the history: its distinct digests are
dealt over partitions, and each partition gets a minimal perfect hash (levels
of collision-free bits; the rank of a digest's bit is its slot). A slot holds
the full digest, the winner's ``doc_id`` and the number of rows. Arrivals are
grouped by digest before they are looked up, so a text with very many copies
is one lookup; a hit counts only if all 32 bytes agree. Hits join the slot's
group, digests that are no members form groups of their own.

Texts are equal when identical; null counts as empty, and long texts are hashed
whole. Of equal texts the row with the largest ``doc_id`` stays; a null id loses
to any other. Every row gets a row, and exactly one of a group is kept: rows
repeated with the same id and text are aggregated first, and of those that win,
one is kept (``keep`` takes the one with the smallest hash of all columns). An
empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so
further columns may have any name; ``keep`` passes all columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import scratch

#: Digests that a partition of the index holds, about.
SLOTS = 200_000
#: Repeats of a document that one task writes out.
REPEATS = 100_000
INDEX = "part int, sizes array<long>, bits binary, digests binary, winners binary, rows binary"
GROUPS = "digest binary, keep_id long, group_size long"
NO_ID = np.iinfo(np.int64).min
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = digests[:, level % 4] * _ODD[level % 4] + digests[:, (level + 1) % 4] * np.uint64(2 * level + 1)
            h ^= h >> np.uint64(31)
            h *= _ODD[(level + 2) % 4]
            return ((h >> np.uint64(7)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], digests
        while len(left):
            size = 2 * len(left) + 1
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each member; of others any slot, or -1."""
        out = np.full(len(digests), -1, np.int64)
        live, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(digests[live], level, size)
            hit = self.bits[at]
            out[live[hit]] = self.rank[at[hit]]
            live, base = live[~hit], base + size
        return out


def as_words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """32-byte digests as rows of four numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _part(parts: int):
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % parts).cast("int").alias("part")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, digest and number of rows of each document, as a table."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest).groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    return scratch.materialise(rows, "digests")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("copies").alias("rows"))


def build_index(groups: DataFrame, parts: int) -> DataFrame:
    """digest, winner, rows -> a row for each part of the index."""

    def build(table: pa.Table) -> pa.Table:
        words = as_words(table.column("digest"))
        function = PerfectHash.build(words)
        slot = function.slots(words)
        order = np.empty_like(slot)
        order[slot] = np.arange(len(slot))
        winners, rows = ids(table.column("winner"))[order], ids(table.column("rows"))[order]
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sizes": pa.array([function.sizes], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(function.bits).tobytes()]), "digests": pa.array([words[order].tobytes()]),
            "winners": pa.array([winners.tobytes()]), "rows": pa.array([rows.tobytes()]),
        })

    return groups.select("*", _part(parts)).groupBy("part").applyInArrow(build, INDEX)


def look_up(groups: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Groups of arrivals joined with the index: a row for each distinct digest of either."""

    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        words = as_words(new.column("digest"))
        winner, rows = ids(new.column("winner")), ids(new.column("rows"))
        if old.num_rows:
            row = {k: old.column(k)[0].as_py() for k in ("sizes", "bits", "digests", "winners", "rows")}
            function = PerfectHash(row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool))
            held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
            kept, count = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["rows"], np.int64).copy()
            slot = function.slots(words)
            member = slot >= 0
            member[member] = (held[slot[member]] == words[member]).all(axis=1)
            at = slot[member]
            kept[at] = np.maximum(kept[at], winner[member])
            count[at] += rows[member]
            words, winner, rows = np.concatenate((held, words[~member])), np.concatenate((kept, winner[~member])), np.concatenate((count, rows[~member]))
        raw = words.tobytes()
        return pa.table({
            "digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
            "keep_id": pa.array(winner, mask=winner == NO_ID), "group_size": pa.array(rows),
        })

    return groups.select("*", _part(parts)).groupBy("part").cogroup(index.groupBy("part")).applyInArrow(probe, GROUPS)


def groups(rows: DataFrame, history: float = 0.5) -> DataFrame:
    """Groups of equal texts. ``history``: the share of the documents, by ``doc_id`` from below, whose digests are indexed."""
    spark = rows.sparkSession
    cut, n = rows.agg(F.percentile_approx("doc_id", history, 1000), F.count("*")).first()
    earlier = F.coalesce(F.col("doc_id") <= F.lit(cut).cast("long"), F.lit(False))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // SLOTS)
    index = scratch.materialise(build_index(grouped(rows.filter(earlier)), parts), "perfect_hash")
    return look_up(grouped(rows.filter(~earlier)), index, parts)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, whether it wins, and the number of copies of each document."""
    rows = documents(docs)
    joined = rows.join(groups(rows).filter("group_size > 1"), "digest", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("wins"), "copies",
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    found = scratch.materialise(judged(docs), "verdicts")
    out = lambda df, kept: df.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    # copies are dealt out in runs, so that no task writes all copies of one document
    runs = found.filter("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(REPEATS).cast("long"))))
    last = F.least(F.col("copies"), F.col("run") + REPEATS - 1)
    again = runs.repartition("digest", "doc_id", "run").withColumn("number", F.explode(F.sequence(F.col("run"), last)))
    return out(found.filter("copies = 1"), F.col("wins")).unionByName(out(again, F.col("wins") & (F.col("number") == 1)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = scratch.materialise(judged(docs).filter("NOT wins OR copies > 1").select("doc_id", F.lower(F.hex("digest")).alias("sha"), "wins"), "exact_copies")
    own_id, own_sha = scratch.unused(docs, "_id", "_sha")
    named = found.select(F.col("doc_id").alias(own_id), F.col("sha").alias(own_sha), "wins")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (sha == F.col(own_sha))
    left = docs.join(named.filter("NOT wins").drop("wins"), same, "left_anti")
    again = named.filter("wins").drop("wins")
    if not again.limit(1).count():
        return left
    return left.join(again, same, "left_anti").unionByName(scratch.one_of_each(left.join(again, same, "left_semi"), F.col("doc_id").cast("long"), sha))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
