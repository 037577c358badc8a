"""A training corpus from raw documents: five stages, each a table.

Documents that the quality rules reject go, then exact copies but the one with
the largest ``doc_id``, then near copies but the one that names its component; the
rest is repeated by source and shuffled, and encoded. Every stage takes all rows
that the one before kept, with all their columns, whatever their names.

Null and empty texts have no words and go in the first stage. Rows with a null
``doc_id`` stay like others; against a document with an id they lose. Repeated rows
are one document after the second stage, the row with the smallest hash of all
columns. Texts with equal ids are near copies of each other. A null source is a
source of its own. Texts are taken whole, however long. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe_codec, exact_dedup, mixing, quality_rules, scratch, simhash_dedup
from tokenloom.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_dedup.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_codec.digests(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mixed),
    ("bpe encoding", encoded),
]

#: Fingerprints, merges and the fitted model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.made()
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        scratch.drop(spark, begun)  # what led to this table
    return STAGES[-1][1](spark, docs, sf_dir)
