"""The two quality operators against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from tokenloom.llm import quality_rules, weak_labels
from tokenloom.llm.quality_rules import repeated_lines

DATA = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def ascii_lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode())


def grams(text, buckets):
    """Buckets of the unigrams and bigrams."""
    h = [int.from_bytes(hashlib.md5(ascii_lower(w.decode())).digest()[:8]) for w in text.encode().split()]
    out = [(x >> 32) % buckets for x in h]
    for x, y in zip(h, h[1:]):
        p = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) & M
        p = ((p ^ p >> 29) * 0xBF58476D1CE4E5B9) & M
        out.append((p >> 32) % buckets)
    return out


def failed(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


@pytest.mark.parametrize("settings", [quality_rules.Settings(), quality_rules.Settings(buckets=97, threshold=-0.02, smoothing=0.5, trusted_rows=20)])
def test_likelihood_ratio_and_verdict(spark, settings):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = labels.selectExpr("doc_id", "md5(CAST(doc_id AS STRING)) AS h", "quality", "toxic").filter("quality = 1 AND toxic = 0").orderBy("h", "doc_id").limit(settings.trusted_rows)
    trusted = {r.doc_id for r in order.collect()}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        own = grams(t, settings.buckets)
        raw.update(own)
        if i in trusted:
            target.update(own)
    share = target.total() / raw.total()
    ratio = {b: math.log(target[b] + settings.smoothing) - math.log(raw[b] * share + settings.smoothing) for b in raw}
    rows, kept = quality_rules.verdicts(docs, labels, settings).collect(), set()
    for r in rows:
        own = grams(texts[r.doc_id], settings.buckets)
        want = math.fsum(ratio[b] for b in own) / max(len(own), 1)
        assert abs(r.llr - want) < 1e-8
        assert r.kept == (not failed(texts[r.doc_id]) and r.llr >= settings.threshold)
        kept |= {r.doc_id} if r.kept else set()
    assert len(rows) == len(texts) and 0 < len(kept) < len(rows)
    assert {r.doc_id for r in quality_rules.keep(docs, labels, settings).collect()} == kept


def test_quality_rules_of_very_long_texts(spark, long_text):
    n = len(long_text.encode().split())
    df = spark.createDataFrame([(1, long_text), (2, " ".join(f"w{i}" for i in range(400_000)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.verdicts(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert rows[1].n_words == n and rows[1].base_failed and rows[1].n_repeat_words > 0.9 * n
    assert (rows[2].n_words, rows[2].n_repeat_words, rows[2].kept) == (400_000, 0, True)


def plain_votes(text):
    words = [w.decode() for w in text.encode().split()]
    n, count = len(words), Counter(words)
    mean = lambda f: sum(map(f, words)) / max(n, 1)
    vote = lambda bad, good: -1 if n and bad else 1 if n and good else 0
    length, symbols, ends = mean(len), mean(lambda w: sum(c in "#*$%&|<>" for c in w)), mean(lambda w: w[-1] in ".!?,;:")
    capitals = mean(lambda w: w.upper() == w and bool(regex.search(r"\p{L}\p{L}", w)))
    blank, long = mean(lambda w: not regex.search(r"[\p{L}\p{N}]", w)), n >= 20
    variety, top = len(count) / math.sqrt(max(n, 1)), max(count.values(), default=0) / max(n, 1)
    again = repeated_lines(text) / (text.count("\n") + 1)
    return (
        -1 if n < 5 else 1 if n >= 50 else 0, vote(length < 2.5 or length > 14, 3.2 < length < 11), vote(symbols > 0.15, symbols < 0.05), vote(capitals > 0.5, capitals < 0.2),
        vote(long and variety < 2, variety > 3.5), vote(long and (ends < 0.005 or ends > 0.6), 0.02 < ends < 0.4), vote(again > 0.3, again < 0.1), vote(long and top > 0.2, top < 0.12), vote(blank > 0.2, blank < 0.05),
    )


def plain_posteriors(patterns, rounds):
    """Expectation-maximisation with loops, over Counter of vote tuples."""
    post = {v: min(max(0.5 + sum(v) / 18, 0.05), 0.95) for v in patterns}
    for _ in range(rounds):
        weight = [{v: (1 - post[v]) * n for v, n in patterns.items()}, {v: post[v] * n for v, n in patterns.items()}]
        table = [[{x: 1 + sum(w for v, w in weight[c].items() if v[j] == x) for x in (-1, 0, 1)} for j in range(9)] for c in (0, 1)]
        prior = (sum(weight[1].values()) + 1) / (sum(patterns.values()) + 2)
        new = {}
        for v in patterns:
            like = [math.log((1 - prior, prior)[c]) + sum(math.log(table[c][j][v[j]] / sum(table[c][j].values())) for j in range(9)) for c in (0, 1)]
            new[v] = 1 / (1 + math.exp(like[0] - like[1]))
        done = max(abs(new[v] - post[v]) for v in patterns) < 1e-9
        post = new
        if done:
            break
    return post


def plain_features(text, buckets):
    words = [w.decode() for w in text.encode().split()]
    found = Counter()
    for w in words:
        upper = w.upper() == w and bool(regex.search(r"\p{L}\p{L}", w))
        code = ((min(len(w), 15) * 4 + min(sum(c in "#*$%&|<>" for c in w), 3)) * 2 + upper) * 2 + bool(re.search(r"[.!?,;:]$", w))
        code = (code * 2 + (not regex.search(r"[\p{L}\p{N}]", w))) * 0x9E3779B97F4A7C15 & M
        for h in (int.from_bytes(xxhash.xxh3_64_digest(ascii_lower(w))), code):
            found[(h >> 20) % buckets] += 1
    found[buckets] = sum(a == b for a, b in zip(words, words[1:]))
    return {b: n / len(words) for b, n in found.items() if n}


def test_scorer_against_plain_gradients(spark):
    s = weak_labels.Settings(buckets=61, steps=12, rounds=40)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in rows if len(r.text or "") < 1500}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    votes = {i: plain_votes(t) for i, t in texts.items()}
    post = plain_posteriors(Counter(votes.values()), s.rounds)
    own = {i: plain_features(t, s.buckets) for i, t in texts.items()}
    target = {i: post[votes[i]] for i in texts}
    good = sum(t >= 0.5 for t in target.values())
    scale = {i: 0.5 / max(good, 1) if t >= 0.5 else 0.5 / max(len(target) - good, 1) for i, t in target.items()}
    w, squares = [0.0] * (s.buckets + 2), [1e-12] * (s.buckets + 2)
    total = sum(scale.values())
    for _ in range(s.steps):
        gradient = [s.decay * x for x in w]
        for i, found in own.items():
            z = sum(w[b] * float(np.float32(x)) for b, x in found.items()) + w[-1]
            error = (1 / (1 + math.exp(-z)) - target[i]) * scale[i] / total
            for b, x in found.items():
                gradient[b] += error * float(np.float32(x))
            gradient[-1] += error
        squares = [q + g * g for q, g in zip(squares, gradient)]
        w = [x - s.rate * g / math.sqrt(q) for x, g, q in zip(w, gradient, squares)]
    got = {r.doc_id: r for r in weak_labels.classify(df, s).collect()}
    for i, found in own.items():
        want = 1 / (1 + math.exp(-(sum(w[b] * x for b, x in found.items()) + w[-1])))
        assert abs(got[i].score - want) < 1e-4 and got[i].kept == (got[i].score >= s.threshold)
    assert 0 < good < len(texts)
    assert {r.doc_id for r in weak_labels.keep(df, s).collect()} == {i for i, r in got.items() if r.kept}


def test_samples_are_bounded_and_very_long_texts_scored(spark, long_text):
    rows = [(None, f"the {n} stones of a river lie, as ever, under the old bridge near house {n}.") for n in range(300)] + [(1, long_text), (2, "# $ %% !! ##")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (weak_labels.Settings(sample_rows=50), weak_labels.Settings(sample_bytes=1000), weak_labels.Settings(sample_features=100), weak_labels.Settings()):
        got = weak_labels.classify(df, s).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
