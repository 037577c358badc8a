"""Text lines in, normalized lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import normalize_bytes

#: A physical line, its end included, counts as several of at most so many bytes.
LINE_BYTES = 16_383


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (BINARY): lines ended by LF alone, long ones cut by bytes, wherever that falls.

    The end of a line counts, so a line of exactly ``LINE_BYTES`` is followed by an empty one.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("raw"))
    cuts = F.sequence(F.lit(1), F.octet_length("raw") + 1, F.lit(LINE_BYTES))
    return raw.select(F.explode(F.transform(cuts, lambda i: F.substring("raw", i, F.lit(LINE_BYTES)))).alias("value"))


def normalize_file(spark: SparkSession, source: str, target: str) -> int:
    """Write the normalized lines as a text data set; the number of lines."""
    lines = read_lines(spark, source).select(normalize_bytes(F.col("value")).cast("string").alias("value"))
    lines.write.text(target)
    return spark.read.text(target, lineSep="\n").count()
