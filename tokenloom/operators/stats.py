"""Reports over encoded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as X
from tokenloom.functions.decode import decode
from tokenloom.operators.encode import encode_ordinary
from tokenloom.sources.vocab import Encoding


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(X.pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def top(df: DataFrame, k: int, *tie: str, count: str = "n") -> DataFrame:
    return df.orderBy(F.desc(count), *tie).limit(k)


def token_frequencies(encoded: DataFrame, tokens: str = "tokens") -> DataFrame:
    return encoded.select(F.explode(tokens).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


def tokens_by(encoded: DataFrame, *keys: str, tokens: str = "tokens") -> DataFrame:
    return encoded.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum(F.size(tokens)).alias("tokens"))


def round_trip(df: DataFrame, encoding: Encoding, key: str, text: str = "text") -> DataFrame:
    """Whether the decoded ids give the text back, underscores and what follows a NUL aside."""
    coded = encode_ordinary(df.select(key, text), encoding, text)
    back = decode(F.col("tokens"), encoding)
    wanted = F.replace(X.before_nul(F.col(text)), F.lit("_"), F.lit(""))
    return coded.select(key, back.alias("decoded"), (back == F.col(text)).alias("exact"), (back == wanted).alias("expected"))


def compare(df: DataFrame, encodings: dict[str, Encoding], text: str = "text") -> DataFrame:
    """Texts, characters and ids under each vocabulary."""
    out = None
    for name, encoding in encodings.items():
        coded = encode_ordinary(df.select(text), encoding, text)
        row = coded.agg(F.count("*").alias("docs"), F.sum(F.char_length(text)).alias("chars"), F.sum(F.size("tokens")).alias("tokens")).select(F.lit(name).alias("encoding"), "*")
        out = row if out is None else out.unionByName(row)
    return out
