"""Operator 6: a weak-label quality classifier.

Nine heuristics vote good, bad or nothing on every document. The votes of all
documents are counted by pattern (at most 3**9), and expectation-maximisation
on these counts estimates how often each heuristic says what of good and of bad
documents, without any label. The posteriors of the patterns then label a
sample of at most ``sample_rows`` documents with ``sample_bytes`` of text and
``sample_features`` features (those with the smallest hashed ids; ties by posterior
and features), on which a logistic scorer over hashed words and word marks
(length, symbols, capitals, ending) and repeats is trained. It scores every
document; one stays if its score is at least ``threshold``, equality included.

A null or empty text has no words: only the length heuristic votes. A very long
text is scored whole, in a slice of its own. Repeated rows get a row each. An
empty table gives an empty result. ``keep`` passes all columns through, whatever
their names; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import words as W
from tokenloom.llm.quality_rules import repeated_lines

LABELLERS = ["length", "word_length", "symbols", "capitals", "variety", "punctuation", "lines", "top_word", "letters"]


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    sample_rows: int = 12_000
    sample_bytes: int = 256 << 20
    sample_features: int = 30_000_000
    rounds: int = 100
    steps: int = 60
    rate: float = 1.0
    decay: float = 1e-5
    threshold: float = 0.25


@dataclass
class Marks:
    """What the heuristics and the scorer look at in a single word."""

    length: np.ndarray
    symbols: np.ndarray
    upper: np.ndarray
    ends: np.ndarray
    blank: np.ndarray

    @classmethod
    def of(cls, vocabulary: pa.Array) -> Marks:
        plain = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
        upper = pc.and_(pc.equal(pc.utf8_upper(vocabulary), vocabulary), pc.match_substring_regex(vocabulary, r"\pL\pL"))
        return cls(
            plain(pc.utf8_length(vocabulary)), plain(pc.count_substring_regex(vocabulary, r"[#*$%&|<>]")), plain(upper),
            plain(pc.match_substring_regex(vocabulary, r"[.!?,;:]$")), plain(pc.invert(pc.match_substring_regex(vocabulary, r"[\pL\pN]"))),
        )

    def code(self) -> np.ndarray:
        return (((np.minimum(self.length, 15) * 4 + np.minimum(self.symbols, 3)) * 2 + self.upper) * 2 + self.ends) * 2 + self.blank


def votes(column: pa.Array, words: W.Words) -> np.ndarray:
    """texts x labellers of -1, 0, 1."""
    texts = W.nonnull(column)
    n = words.counts.astype(float)
    safe = np.maximum(n, 1)
    marks = Marks.of(words.vocabulary)
    owner = np.repeat(np.arange(len(n)), words.counts)
    share = lambda per_word: np.bincount(owner, weights=per_word.astype(float)[words.codes], minlength=len(n)) / safe
    length, symbols, capitals, ends, blank = map(share, (marks.length, marks.symbols, marks.upper, marks.ends, marks.blank))
    size = max(len(words.vocabulary), 1)
    pairs, times = np.unique(owner * size + words.codes, return_counts=True)
    where = pairs // size
    variety = np.bincount(where, minlength=len(n)) / np.sqrt(safe)
    top = np.zeros(len(n))
    np.maximum.at(top, where, times)
    top = top / safe
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False)
    again = np.fromiter(map(repeated_lines, texts.to_pylist()), float, len(texts)) / lines
    some, long = n > 0, n >= 20

    def vote(bad, good):
        return np.where(some & bad, -1, np.where(some & good, 1, 0))

    return np.stack([
        np.where(n < 5, -1, np.where(n >= 50, 1, 0)), vote((length < 2.5) | (length > 14), (length > 3.2) & (length < 11)), vote(symbols > 0.15, symbols < 0.05),
        vote(capitals > 0.5, capitals < 0.2), vote(long & (variety < 2.0), variety > 3.5), vote(long & ((ends < 0.005) | (ends > 0.6)), (ends > 0.02) & (ends < 0.4)),
        vote(again > 0.3, again < 0.1), vote(long & (top > 0.2), top < 0.12), vote(blank > 0.2, blank < 0.05),
    ], axis=1).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def unpack(patterns: np.ndarray, k: int = len(LABELLERS)) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(k) % 3 - 1


def expectation_maximisation(v: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good by pattern; P(good), as an array; and P(vote | class) as classes x labellers x 3.

    Starts from the share of votes; a heuristic that never votes stays neutral.
    """
    k = v.shape[1]
    post = np.clip(0.5 + v.sum(axis=1) / (2 * k), 0.05, 0.95) if len(v) else np.zeros(0)
    table, prior = np.full((2, k, 3), 1 / 3), np.array([0.5])
    for _ in range(rounds):
        weight = np.stack([(1 - post) * count, post * count])
        table = np.stack([[[weight[c][v[:, j] == x].sum() + 1 for x in (-1, 0, 1)] for j in range(k)] for c in (0, 1)])
        table = table / table.sum(axis=2, keepdims=True)
        prior = np.array([(weight[1].sum() + 1) / (count.sum() + 2)])
        logs = np.log(table)[:, np.arange(k), v + 1].sum(axis=2) + np.log([1 - prior[0], prior[0]])[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if len(v) and np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, prior, table


def accuracies(table: np.ndarray) -> dict[str, float]:
    """How often each heuristic is right when it votes, classes weighing the same."""
    right = (table[0, :, 0] / (table[0, :, 0] + table[0, :, 2]) + table[1, :, 2] / (table[1, :, 0] + table[1, :, 2])) / 2
    return dict(zip(LABELLERS, right.tolist()))


def hashes(vocabulary: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in pc.ascii_lower(vocabulary).cast(pa.large_binary()).to_pylist()]), ">u8").astype(np.uint64)


def buckets_of(words: W.Words, buckets: int) -> list[np.ndarray]:
    """The hashed features of each distinct word: itself, lower-cased, and its marks."""
    code = Marks.of(words.vocabulary).code().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64) for h in (hashes(words.vocabulary), code)]


def echoes(words: W.Words, owner: np.ndarray) -> np.ndarray:
    """Words of each text that repeat the word before."""
    same = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=len(words.bounds) - 1)


def features(words: W.Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and share of the text's words, for every hashed feature; the last bucket is for echoes."""
    texts = len(words.bounds) - 1
    owner = np.repeat(np.arange(texts), words.counts)
    keys = np.concatenate([owner * (buckets + 1) + b[words.codes] for b in buckets_of(words, buckets)])
    keys, times = np.unique(keys, return_counts=True)
    echo = echoes(words, owner)
    some = np.flatnonzero(echo)
    text = np.concatenate((keys // (buckets + 1), some))
    order = np.argsort(text, kind="stable")
    bucket, weight = np.concatenate((keys % (buckets + 1), np.full(len(some), buckets))), np.concatenate((times, echo[some]))
    return text[order], bucket[order], weight[order] / words.counts[text[order]]


def train(text: np.ndarray, bucket: np.ndarray, weight: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Logistic regression by full gradients, each coordinate at its own rate; the last number is the bias. Both classes weigh the same."""
    w = np.zeros(s.buckets + 2)
    if not len(target):
        return w
    squares = np.full_like(w, 1e-12)
    scale = np.where(target >= 0.5, 0.5 / max((target >= 0.5).sum(), 1), 0.5 / max((target < 0.5).sum(), 1))
    scale = scale / scale.sum()
    for _ in range(s.steps):
        z = np.bincount(text, weights=w[bucket] * weight, minlength=len(target)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * scale
        gradient = np.append(np.bincount(bucket, weights=error[text] * weight, minlength=s.buckets + 1), error.sum()) + s.decay * w
        squares += gradient**2
        w = w - s.rate * gradient / np.sqrt(squares)
    return w


@dataclass
class Model:
    posterior: np.ndarray
    weights: np.ndarray
    accuracy: dict[str, float]
    prior: float


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                total += np.bincount(pattern(votes(part.column("text"), W.split(part.column("text")))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    found = rows.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas().to_numpy(np.int64)
    v = unpack(found[:, 0])
    post, prior, table = expectation_maximisation(v, found[:, 1], s.rounds)
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    posterior[found[:, 0]] = post
    shared = spark.sparkContext.broadcast(posterior)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.split(part.column("text"))
                text, bucket, weight = features(w, s.buckets)
                order = np.bincount(text, minlength=part.num_rows)
                bounds = pa.array(np.concatenate(([0], np.cumsum(order))).astype(np.int32))
                target = shared.value[pattern(votes(part.column("text"), w))]
                yield pa.record_batch([part.column("h"), pa.array(target), pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(weight.astype(np.float32)))], names=["h", "target", "bucket", "weight"])

    def learn(table: pa.Table) -> pa.Table:
        lists = [table.column(c).combine_chunks() for c in ("bucket", "weight")]
        size = pc.list_value_length(lists[0]).to_numpy()
        text = np.repeat(np.arange(table.num_rows), size)
        w = train(text, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(float), table.column("target").to_numpy(), s)
        return pa.table({"weights": pa.array([np.round(w, 9).tolist()])})

    key = F.xxhash64("doc_id")
    first = rows.select(key.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("h", "size").limit(s.sample_rows)
    before = F.sum("size").over(Window.orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")  # over sample_rows rows
    largest = first.withColumn("before", before).filter(F.col("before") <= s.sample_bytes).agg(F.max("h")).first()[0]
    near = rows.select(key.alias("h"), "text").filter(F.col("h") <= F.lit(largest if largest is not None else 0))
    sample = near.mapInArrow(sampled, "h long, target double, bucket array<int>, weight array<float>").orderBy("h", "target", F.hash("bucket")).limit(s.sample_rows)
    before = F.sum("size").over(Window.orderBy("h", "target", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    sample = sample.select("*", F.size("bucket").alias("size"), F.hash("bucket").alias("tie")).withColumn("before", before).filter(F.col("before") <= s.sample_features).drop("size", "tie", "before")
    learnt = sample.groupBy().applyInArrow(learn, "weights array<double>").collect() if largest is not None else []
    weights = np.array(learnt[0][0]) if learnt else np.zeros(s.buckets + 2)
    return Model(posterior, weights, accuracies(table), float(prior[0]))


def score(column: pa.Array, model: Model, s: Settings) -> np.ndarray:
    """The scorer's probability of good: the mean weight of a text's features, added up by distinct word."""
    w = W.split(column)
    n = len(w.bounds) - 1
    owner = np.repeat(np.arange(n), w.counts)
    each = sum(model.weights[b] for b in buckets_of(w, s.buckets))
    total = np.bincount(owner, weights=each[w.codes], minlength=n) + model.weights[s.buckets] * echoes(w, owner)
    z = total / np.maximum(w.counts, 1) + model.weights[-1]
    return np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6)


def classify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, score and kept of each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                p = score(part.column("text"), model.value, s)
                yield pa.record_batch([part.column("doc_id"), pa.array(p), pa.array(p >= s.threshold)], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, kept boolean")


def keep(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows that stay, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield part.filter(pa.array(score(part.column("text"), model.value, s) >= s.threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
