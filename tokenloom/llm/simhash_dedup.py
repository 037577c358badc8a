"""Operator 9: near-duplicates by SimHash and a byte-position inverted index.

A fingerprint has eight bytes. Two that differ in at most two bits differ in
at most two bytes, so at least six bytes agree position by position: the
guaranteed minimum. Lists of single positions hold a 256th of all fingerprints,
and pairing within them is quadratic; so the index is read six positions at a
time. A list has the fingerprints with the same bytes at six given positions,
and every fingerprint is in 28 lists. In each list the shared positional bytes
of every pair are tallied, pairs below the minimum go, and the rest are verified
bit by bit. A pair with six matches meets in one list, one with seven in seven.

There is one way for lists of all sizes. A list holds at most 2**16 distinct
fingerprints, as two bytes are free: 1 MB of memory and 2**31 tallies, about 20
seconds, in the worst case. However many fingerprints agree in fewer positions,
they are dealt over as many lists, and lists over tasks. Random fingerprints
meet by the 2**48th part, and a list gives at most one link a fingerprint.

Equal fingerprints are one node from the start, so no group of copies is ever
listed pair by pair.

Null and empty texts have no words: fingerprint zero, linked like any other. A
very long text is hashed whole, in a slice of its own. Rows with a null
``doc_id`` never name a component; if only such rows reach each other, the
component is null. Repeated rows get a row each. An empty table gives an empty
result. Further columns are ignored, whatever their names, and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import scratch
from tokenloom.llm import words as W
from tokenloom.llm.components import components, local_roots

SHINGLE, SEED, BITS, MATCHES = 3, 42, 2, 6
#: Positions of each list of the index.
SETS = list(combinations(range(8), MATCHES))
#: Bytes of text at a time; a shingle takes some hundred bytes while it is hashed.
SLICE_BYTES = 2 << 20
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text (uint64)."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(W.nonnull(column)))
    w = W.split(pc.ascii_lower(W.nonnull(column)))
    joined = W.nonnull(pc.binary_join(_full(lists), pa.scalar(" ", pa.large_string())))
    n = w.counts
    out = np.zeros(len(n), np.uint64)
    if not len(w.codes):
        return out
    length = pc.binary_length(w.vocabulary).to_numpy().astype(np.int64)[w.codes]
    start = np.cumsum(length + 1) - (length + 1)
    text = np.repeat(np.arange(len(n)), n)
    first = w.bounds[:-1]
    base = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(n) + 1]
    start += (base[:-1] - start[np.minimum(first, len(start) - 1)])[text]
    end = start + length
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    head = W.spans(first, count)
    tail = np.minimum(head + SHINGLE, w.bounds[1:][np.repeat(np.arange(len(n)), count)]) - 1
    raw = joined.buffers()[2].to_pybytes()
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(raw[i:j], SEED) for i, j in zip(start[head].tolist(), end[tail].tolist())]), ">u8").astype("<u8")
    # eight counters of eight bits in a number, over at most 255 shingles
    bounds = np.concatenate(([0], np.cumsum(count)))
    pieces = -(-count // 255)
    owner = np.repeat(np.arange(len(n)), pieces)
    cuts = bounds[:-1][owner] + 255 * (W.spans(np.zeros(len(n), np.int64), pieces))
    whole = np.flatnonzero(n)
    firsts = np.concatenate(([0], np.cumsum(pieces)))[:-1][whole]
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * byte)).astype(np.uint8)], cuts)
        each = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        bits = 2 * each > count[whole][:, None]
        out[whole] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def _full(lists: pa.Array) -> pa.Array:
    """The lists without empty words."""
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    return pa.LargeListArray.from_arrays(pa.array(bounds), flat.filter(pa.array(full)).cast(pa.large_string()))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint (as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array(fingerprints(part.column("text")).view(np.int64))], names=["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def postings(nodes: DataFrame) -> DataFrame:
    """A row for each distinct fingerprint and list: the positions' number, their bytes, and the fingerprint."""

    def key(k: int, positions: tuple[int, ...]):
        mask = sum(0xFF << (8 * p) for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bytes"))

    return nodes.select(F.explode(F.array(*[key(k, p) for k, p in enumerate(SETS)])).alias("key"), "fp").select("key.k", "key.bytes", "fp")


def tally(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The number of positions at which the bytes of two fingerprints agree."""
    x = u ^ v
    for shift in (4, 2, 1):
        x |= x >> np.uint64(shift)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def list_links(size: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints in lists of these sizes, one list after the other."""
    later = np.repeat(size, size) - W.spans(np.zeros(len(size), np.int64), size) - 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, d = np.flatnonzero(later), 1
    while len(live):
        i = live[tally(fp[live], fp[live + d]) >= MATCHES]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= BITS]
        left.append(i)
        right.append(i + d)
        d += 1
        live = live[later[live] >= d]
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> links ``u, v`` between them, at most one a fingerprint and list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # at most one list

        def linked(k, key, fp):
            if not len(k):
                return
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (key[1:] != key[:-1]))))
            i, j = list_links(np.diff(np.append(first, len(k))), fp.view(np.uint64))
            if len(i):
                node, root = local_roots(fp[i], fp[j])
                far = node != root
                yield pa.record_batch([pa.array(node[far]), pa.array(root[far])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            now = [np.concatenate(p) for p in zip(held, new)] if held else new
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            done = len(last) - int(last.sum())  # sorted: the last list may go on
            yield from linked(*[c[:done] for c in now])
            held = [c[done:].copy() for c in now]
        if held:
            yield from linked(*held)

    dealt = postings(nodes).repartition("k", "bytes").sortWithinPartitions("k", "bytes")
    return dealt.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp and component_id of each row."""
    rows = scratch.materialise(signatures(docs), "fingerprints")
    nodes = scratch.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # fingerprints are the nodes, as some have no id; those with one id belong together
    first = nodes.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    same = nodes.join(scratch.materialise(first, "repeated_ids"), "rep").select(F.col("fp").alias("u"), "v").filter("u <> v")
    found = components(links(nodes.select("fp")).unionByName(same))
    linked = scratch.materialise(nodes.join(found, nodes.fp == found.node).select("fp", "rep", "component"), "linked")
    names = scratch.materialise(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "names")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    named = linked.join(names, "component").select("fp", "component_id").unionByName(alone)
    return rows.join(scratch.materialise(named, "classes"), "fp")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document that names it, with all columns.

    A document is its id and text, and repeated rows are one: that with the
    smallest hash of all columns stays. Of different texts with the id that names
    the component, the one with the smaller hash stays.
    """
    found = scratch.materialise(classes(docs), "near_copies")
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = named.groupBy("component_id", "doc_id").agg(F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key"), F.count("*").alias("n"))
    twice = scratch.materialise(first.filter("n > 1"), "repeated")
    lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key")
    lost = lost.unionByName(named.join(twice.filter("first_key < last_key").select("component_id", "first_key"), "component_id").filter("text_key > first_key").select("doc_id", "text_key"))
    own_id, own_key = scratch.unused(docs, "_id", "_key")
    lost = lost.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_key))
    left = docs.join(lost, same, "left_anti")
    if not twice.limit(1).count():
        return left
    again = twice.select(F.col("doc_id").alias(own_id), F.col("first_key").alias(own_key))
    return left.join(again, same, "left_anti").unionByName(scratch.one_of_each(left.join(again, same, "left_semi"), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
