"""The whole pipeline on odd and empty tables, against plain Python."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tokenloom.llm import mixing, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, kept string, copy string, ids string"
WORDS = [f"{a}{b}" for a in ("river", "stone", "cloud", "né", "x1", "Brook", "fern") for b in ("", "s", ",", ".", "!", "ly", "er")]


def prose(seed, n):
    return " ".join(WORDS[(seed * 131 + i * i * 7 + i // 3) % len(WORDS)] + str((seed * 17 + i * 31) % 97) for i in range(n))


def rows(long_text):
    base = [(n, prose(n, 60 + n)) for n in range(40)]
    out = base + [(None, prose(3, 63)), (None, prose(200, 80)), (None, prose(200, 80)), (None, None), (50, None), (51, ""), (52, " \t\n"), (53, "too short")]
    out += [(100 + n, prose(5, 65)) for n in range(30)]  # exact copies
    out += [(7, prose(7, 67))] * 4 + [(8, prose(9, 400))] * 2  # repeated rows, and two texts of one id
    out += [(200 + n, prose(300, 900).replace("river", "rivers", n)) for n in range(3)]  # near copies
    out += [(300, " ".join(f"{w}{i}" for i, w in enumerate(long_text.split()[:300_000]))), (301, "same words again and again " * 50)]
    return [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t), "a", "b", "c", "d") for n, (i, t) in enumerate(out)]


def fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def failed(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


def expected(spark, table):
    """(doc_id, text) of what the first three stages keep, without labels."""
    good = [(r[0], r[1]) for r in table if not failed(r[1])]
    low = lambda i: -1 if i is None else i
    last = {}
    for i, t in good:
        if t not in last or low(i) > low(last[t]):
            last[t] = i
    docs = sorted({(i, t) for t, i in last.items()}, key=lambda d: (low(d[0]), d[1]))
    prints = {t: fingerprint(t) for _, t in docs}
    root = list(range(len(docs)))
    find = lambda n: n if root[n] == n else find(root[n])
    for a, b in itertools.combinations(range(len(docs)), 2):
        near = (prints[docs[a][1]] ^ prints[docs[b][1]]).bit_count() <= 2
        if near or (docs[a][0] is not None and docs[a][0] == docs[b][0]):
            root[find(b)] = find(a)
    groups = {}
    for n, d in enumerate(docs):
        groups.setdefault(find(n), []).append(d)
    key = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    kept = set()
    for group in groups.values():
        ids = [i for i, _ in group if i is not None]
        name = min(ids) if ids else None
        kept.add(min((d for d in group if d[0] == name), key=lambda d: key[d[1]]))
    return kept


def test_odd_table(spark, tmp_path, library, long_text):
    table = rows(long_text)
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = expected(spark, table)
    assert 30 < len(kept) < 60 and any(i is None for i, _ in kept)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), SCHEMA
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = scratch.materialise(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    assert {(r.doc_id, r.text) for r in docs.collect()} == kept and docs.count() == len(kept)
    sha = lambda t: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in out) == Counter((r.doc_id, sha(r.text)) for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("n", [0, 1])
def test_empty_table_and_one_row(spark, tmp_path, n):
    spark.createDataFrame([(None, None, None, None, None, None, None, None, None)][:n], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_between_stages_are_removed(spark):
    from pathlib import Path

    folder = Path(scratch.shared_folder(spark).removeprefix("file:").replace("//", "/")) / "tokenloom" / spark.sparkContext.applicationId
    before = set(folder.glob("*/*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {p.name for p in set(folder.glob("*/*")) - before} == {"source_mixing"}
    assert out.count() > 100
