"""Connected components of links between numbered nodes, without any node's links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import scratch


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars round its smallest nodes: never more, and the same components."""
    for b in batches:
        if b.num_rows:
            nodes, roots = local_roots(b.column(0).to_numpy(), b.column(1).to_numpy())
            far = nodes != roots
            yield pa.record_batch([pa.array(nodes[far]), pa.array(roots[far])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``u, v`` (long, not null) -> ``node, component``: the smallest node reached, for every node with a link.

    Large-star and small-star steps take turns until nothing changes. Minima are
    aggregated before they are shuffled and joined from tables of their own, so
    that Spark can split the partition of a node with very many links.
    """
    edges = scratch.materialise(_oriented(links.mapInArrow(contract, "u long, v long")), "links")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large_minima")
        large = _oriented(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = scratch.materialise(large, "large_star")
        low = scratch.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small_minima")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = scratch.materialise(_oriented(small), "small_star")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from its larger node to its smaller."""
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
