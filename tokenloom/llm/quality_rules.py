"""Operator 5: quality rules with a hashed n-gram log-likelihood ratio.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A document that fails
the base rules (too few words, too much repetition) goes. Every other document
is held against two multinomials over hashed unigrams and bigrams, lower-cased:
the trusted target (labelled good and not toxic) and the raw corpus. Its score
is the log-likelihood ratio per n-gram; it stays if the score is at least
``threshold``. The raw counts cover all documents; the target is fitted on at
most ``trusted_rows`` labelled documents, those with the smallest hashed ids.

A null or empty text has no words: all its counts are 0, its score is 0 and
the base rules reject it. Without labels, and for an empty table, the two
models agree, every score is 0 and only the base rules decide. A very long text is
counted and scored whole, in a slice of its own. Repeated rows get a row each; a
score equal to the threshold stays; labelled ids with equal hashes are taken by
id. The filter keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import words as W

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Odd numbers that mix the hashes of two words.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)
SLICE_BYTES = 3 << 20
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    threshold: float = -0.2
    smoothing: float = 2.0
    trusted_rows: int = 20_000
    min_words: int = 20
    repeat_percent: int = 30


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """The first eight bytes of the MD5 of each word, lower-cased; SQL has the same."""
    from hashlib import md5

    raw = b"".join([md5(w, usedforsecurity=False).digest() for w in pc.ascii_lower(vocabulary).cast(pa.large_binary()).to_pylist()])
    return np.frombuffer(raw, ">u8")[::2].astype(np.uint64)


def ngrams(words: W.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and then all bigrams, and the text that each is in."""
    h = hashes(words.vocabulary)[words.codes]
    text = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
    inside = text[1:] == text[:-1]
    pair = (h[:-1] * np.uint64(MIX[0]) + h[1:] * np.uint64(MIX[1]))[inside]
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(MIX[2])
    bucket = np.concatenate((h >> np.uint64(32), pair >> np.uint64(32))) % np.uint64(buckets)
    return bucket.astype(np.int64), np.concatenate((text, text[:-1][inside] if len(text) else text))


def repeated_words(words: W.Words) -> np.ndarray:
    """Words in windows of eight that occur twice or more in their text."""
    n, texts = len(words.codes), len(words.bounds) - 1
    out = np.zeros(texts, np.int64)
    if n < WINDOW:
        return out
    text = np.repeat(np.arange(texts), words.counts)
    ids = words.codes.astype(np.int64)
    span = 1
    # names of windows of 1, 2, 4 and 8 words: equal names, equal windows of one text
    name = ids + text * (int(ids.max()) + 1)
    while span < WINDOW:
        if int(name.max()) >= 3_000_000_000:  # the square would not fit
            name = np.unique(name, return_inverse=True)[1]
        _, name = np.unique(name[:-span] * (int(name.max()) + 1) + name[span:], return_inverse=True)
        span *= 2
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    name = np.where(whole, name, -1)
    found = np.bincount(name[whole], minlength=1) if whole.any() else np.zeros(1, np.int64)
    twice = whole & (found[np.maximum(name, 0)] > 1)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=texts).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    count = 0
    for line in lines:
        if line in seen:
            count += bool(line.strip(" \t\n\v\f\r"))
        seen.add(line)
    return count


def base_counts(column: pa.Array, words: W.Words) -> list[np.ndarray]:
    texts = W.nonnull(column)
    white = pc.count_substring_regex(texts, "[ \t\n\v\f\r]")
    return [
        words.counts,
        pc.subtract(pc.utf8_length(texts).cast(pa.int64()), white.cast(pa.int64())).to_numpy(),
        pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64()).to_numpy(),
        np.fromiter(map(repeated_lines, texts.to_pylist()), np.int64, len(texts)),
        repeated_words(words),
    ]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Log-ratio of target and raw probability by bucket: ``buckets`` numbers."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = np.array(sorted(r[0] for r in good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(s.trusted_rows).collect()), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(s.buckets, np.int64), np.zeros(s.buckets, np.int64)
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                bucket, text = ngrams(W.split(part.column("text")), s.buckets)
                raw += np.bincount(bucket, minlength=s.buckets)
                known = np.isin(pc.fill_null(part.column("doc_id"), -(1 << 62)).to_numpy(), trusted)
                target += np.bincount(bucket[known[text]], minlength=s.buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy(np.int64)
    raw, target = np.zeros(s.buckets), np.zeros(s.buckets)
    raw[sums[:, 0]], target[sums[:, 0]] = sums[:, 1], sums[:, 2]
    if not target.sum():
        return np.zeros(s.buckets)
    # raw counts at the target's size, so that equal smoothing leaves both in proportion
    return np.log(target + s.smoothing) - np.log(raw * (target.sum() / raw.sum()) + s.smoothing)


def judge(column: pa.Array, model: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The five counts, base_failed, kept and the score of each text."""
    words = W.split(column)
    counts = base_counts(column, words)
    n, repeat = counts[0], counts[4]
    failed = (n < s.min_words) | (100 * repeat > s.repeat_percent * n)
    bucket, text = ngrams(words, s.buckets)
    total = np.bincount(text, weights=model[bucket], minlength=len(n))
    llr = np.round(total / np.maximum(np.bincount(text, minlength=len(n)), 1), 9)
    return [*counts, failed, ~failed & (llr >= s.threshold), llr]


def verdicts(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))
    names = [f.name for f in T._parse_datatype_string(COLUMNS).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, judge(part.column("text"), model.value, s))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def keep(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in one pass and without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(judge(part.column("text"), model.value, s)[6]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("llr_micro", F.round(F.col("llr") * 1e6).cast("long")).drop("llr")


_S = Settings()
_M64 = "CAST(18446744073709551616 AS UHUGEINT)"
_PAIR = f"CAST((CAST(h AS UHUGEINT) * {MIX[0]} % {_M64} + CAST(nxt AS UHUGEINT) * {MIX[1]} % {_M64}) % {_M64} AS UBIGINT)"
SQL = rf"""
WITH words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
tok AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words),
code AS (SELECT word, CAST('0x' || substr(md5(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 16) AS UBIGINT) AS h FROM (SELECT DISTINCT word FROM tok)),
coded AS (SELECT doc_id, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tok JOIN code USING (word)),
pair AS (SELECT doc_id, {_PAIR} AS p FROM coded WHERE nxt IS NOT NULL),
gram AS (SELECT doc_id, (h >> 32) % {_S.buckets} AS b FROM coded
  UNION ALL SELECT doc_id, (CAST(CAST(xor(p, p >> 29) AS UHUGEINT) * {MIX[2]} % {_M64} AS UBIGINT) >> 32) % {_S.buckets} FROM pair),
trusted AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {_S.trusted_rows}),
counted AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS target FROM gram GROUP BY b),
total AS (SELECT CAST(sum(raw) AS DOUBLE) AS raws, CAST(sum(target) AS DOUBLE) AS targets FROM counted),
model AS (SELECT b, CASE WHEN targets = 0 THEN 0.0 ELSE ln(target + {_S.smoothing}) - ln(raw * (targets / raws) + {_S.smoothing}) END AS m FROM counted, total),
score AS (SELECT doc_id, round(sum(m) / count(*), 9) AS llr FROM gram JOIN model USING (b) GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM twice, range(0, {WINDOW}) r(k) GROUP BY doc_id),
line AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words)),
again AS (SELECT doc_id, count(*) AS n_lines FROM line WHERE nth > 1 AND regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(llr, 0.0) AS llr
  FROM words LEFT JOIN again USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN score USING (doc_id)),
judged AS (SELECT *, n_words < {_S.min_words} OR 100 * n_repeat_words > {_S.repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= {_S.threshold} AS kept, CAST(round(llr * 1e6) AS BIGINT) AS llr_micro FROM judged
"""
