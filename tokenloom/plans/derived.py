"""A small vocabulary that follows from ``documents``, so that SQL can build the same.

Special tokens come first, then the bytes, the most frequent letter pairs and the
most frequent words of ASCII letters; ties go to the smaller text. Ids of pairs
that there are not enough of are holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.stats import piece_counts
from tokenloom.sources.tables import table
from tokenloom.sources.vocab import Encoding

#: The special tokens, in the order of their ids.
SPECIALS = ["<pad>", "<s>", "</s>", "<system>", "<user>", "<assistant>", "<tool>", "<eot>"]
PAIRS, WORDS = 400, 1500


def base_tokens() -> list[str]:
    return SPECIALS + [f"<0x{b:02X}>" for b in range(256)]


def byte_encoding() -> Encoding:
    return Encoding(tuple(base_tokens()), {t: i for i, t in enumerate(SPECIALS)})


def derived_encoding(docs: DataFrame) -> Encoding:
    words = piece_counts(docs).filter(F.col("piece").rlike("^[A-Za-z]+$"))
    # outer, so that nothing is inferred about single words and both halves share one count of the pieces
    pairs = words.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.length("piece") - 1, F.lit(1))), lambda i: F.substring("piece", i, F.lit(2)))).alias("piece"), "n")
    pairs = pairs.filter(F.length("piece") == 2).groupBy("piece").agg(F.sum("n").alias("n"))
    best = lambda df, k, kind: df.orderBy(F.desc("n"), "piece").limit(k).select(F.lit(kind).alias("kind"), "n", "piece")
    rows = sorted(best(pairs, PAIRS, 0).unionByName(best(words, WORDS, 1)).collect(), key=lambda r: (-r.n, r.piece))  # PAIRS + WORDS rows at most
    found = [r.piece for r in rows if not r.kind]
    tokens = base_tokens() + found + [""] * (PAIRS - len(found)) + [r.piece for r in rows if r.kind]
    return Encoding(tuple(tokens), {t: i for i, t in enumerate(SPECIALS)})


_MADE: dict[tuple[str, str], Encoding] = {}


def of(spark: SparkSession, sf_dir: str) -> Encoding:
    """The vocabulary of a folder's documents, made once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = derived_encoding(table(spark, sf_dir, "documents"))
    return _MADE[key]
