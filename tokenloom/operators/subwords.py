"""A table of subwords and frequencies: the operations of a frequency trie.

A token is valid if it has 1 to 15 bytes and a frequency of 0 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 15


def valid(token: str = "token", freq: str = "freq"):
    size = F.octet_length(F.encode(F.col(token), "UTF-8"))
    return F.col(token).isNotNull() & (size > 0) & (size <= MOST_BYTES) & (F.col(freq) >= 0)


def insert(table: DataFrame | None, rows: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert ``token, freq``; among new rows of one token the last by ``order`` wins."""
    seq = F.col(order) if order else F.col("freq")
    new = rows.filter(valid()).groupBy("token").agg(F.max_by("freq", seq).alias("freq"))
    return new if table is None else table.join(new, "token", "left_anti").unionByName(new)


def search(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Every asked token with its frequency, or -1."""
    return tokens.join(table, "token", "left").select(*tokens.columns, F.coalesce("freq", F.lit(-1)).alias("freq"))


def contains(table: DataFrame, tokens: DataFrame) -> DataFrame:
    return tokens.join(table, "token", "left_semi")


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("tokens"))


def remove(table: DataFrame, tokens: DataFrame) -> DataFrame:
    return table.join(tokens, "token", "left_anti")


def update_frequency(table: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """New frequencies of tokens that are there; others, and negative ones, change nothing. Of several, the last by ``order`` wins."""
    new = rows.filter(F.col("freq") >= 0).groupBy("token").agg(F.max_by("freq", F.col(order or "freq")).alias("new"))
    return table.join(new, "token", "left").select("token", F.coalesce(new["new"], table["freq"]).alias("freq"))


def listing(table: DataFrame) -> DataFrame:
    """Tokens in the order of their bytes. Those of 15 bytes can be searched but are not listed."""
    raw = F.encode("token", "UTF-8")
    return table.filter(F.octet_length(raw) < MOST_BYTES).orderBy(raw)


def sorted_tokens(table: DataFrame, data: str = "bytes") -> DataFrame:
    """BINARY tokens in byte order with their place from 0.

    Places are counted within groups by the first two bytes, and the groups, at
    most 65,793 of them, are counted before.
    """
    raw = F.col(data).cast("binary")
    rows = table.select(raw.alias(data), F.substring(raw, 1, 2).alias("head"))
    heads = rows.groupBy("head").agg(F.count("*").alias("n"))
    before = heads.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    within = rows.withColumn("nth", F.row_number().over(Window.partitionBy("head").orderBy(data)))
    return within.join(F.broadcast(before), "head").select(data, (F.col("before") + F.col("nth") - 1).alias("place"))


def find_prefix(table: DataFrame, prefixes: DataFrame, data: str = "bytes", prefix: str = "prefix") -> DataFrame:
    """The first place in byte order of a token with each prefix, or null. Each token is taken under its own prefixes, as far as any is asked."""
    asked = prefixes.select(F.col(prefix).cast("binary").alias("asked")).distinct()
    longest = asked.agg(F.max(F.octet_length("asked"))).first()[0] or 0
    raw = F.col(data)
    sizes = F.sequence(F.lit(0), F.least(F.octet_length(raw), F.lit(longest)))
    under = sorted_tokens(table, data).select(F.explode(F.transform(sizes, lambda n: F.substring(raw, F.lit(1), n))).alias("asked"), "place")
    first = under.groupBy("asked").agg(F.min("place").alias("place"))
    return prefixes.join(asked.join(first, "asked"), prefixes[prefix].cast("binary") == F.col("asked"), "left").drop("asked")
