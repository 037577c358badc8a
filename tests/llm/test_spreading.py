from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import mixing, scratch, spreading, token_files

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def heavy(spark, monkeypatch):
    """A third of the rows is one document, a third has no id, a third are single rows."""
    monkeypatch.setattr(spreading, "HEAVY", 50)
    monkeypatch.setattr(spreading, "RUN", 7)
    rows = [(7, "same text", "s", 1)] * 300 + [(None, f"text {n % 100}", "s", n % 2) for n in range(300)] + [(n + 100, f"text {n}", "t", 0) for n in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(3)


def test_numbers(spark, heavy):
    got = spreading.numbered(heavy, "place").collect()
    assert Counter(r[:4] for r in got) == Counter(map(tuple, heavy.collect()))
    assert sorted(r.place for r in got if r.doc_id == 7) == list(range(1, 301))
    assert all(r.place == 0 for r in got if r.doc_id and r.doc_id > 7)
    assert len({r for r in got if r.doc_id is None}) == 300  # equal rows have different numbers
    assert {tuple(r) for r in spreading.numbered(heavy.repartition(5), "place").collect()} == {tuple(r) for r in got}
    assert spreading.numbered(heavy.limit(0), "place").count() == 0


def test_mixing_deals_repeated_rows_over_partitions(spark, heavy):
    rows = mixing.replicate(heavy, exponent=1.0, total=9000.0).withColumn("part", F.spark_partition_id()).collect()
    same = [r for r in rows if r.doc_id == 7]
    assert max(Counter(r.part for r in same).values()) < 0.5 * len(same)
    one = Counter(r.copy for r in same)
    assert set(one.values()) == {300}  # every repeat is drawn alike
    assert {r.order_key for r in same if r.copy == 1} == {next(r.order_key for r in same if r.copy == 1)}
    plain = heavy.dropDuplicates(["doc_id", "text"]).filter("doc_id IS NOT NULL")
    assert {(r.doc_id, r.copy) for r in mixing.replicate(plain, exponent=1.0, total=10.0 * plain.count()).collect()} == {(r.doc_id, r.copy) for r in rows if r.doc_id is not None}


def test_token_files_deal_one_id_over_shards(spark, heavy, library):
    path = scratch.fresh_path(spark, "tokens")
    token_files.write(heavy, path, shards=9)
    files = token_files.read(spark, path)
    sizes = {r["shard"]: r["count"] for r in files.groupBy("shard").count().collect()}
    assert len(sizes) == 9 and max(sizes.values()) < 250
    rows = sorted(token_files.documents(spark, path).collect(), key=lambda r: r.start)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert [r.doc_id for r in rows] == [None] * 300 + [7] * 300 + list(range(100, 400))
    texts = {t.text for t in heavy.collect()}
    want = {tuple(library.encode(t, add_special_tokens=False).ids + [1]) for t in texts}
    assert {tuple(r.tokens) for r in files.collect()} == want


def test_layout_of_token_files(spark):
    """Encodings, page indexes, row groups, and a read of a few columns and rows."""
    path = scratch.fresh_path(spark, "tokens")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    token_files.write(docs, path, shards=2, row_group_bytes=1 << 17, page_bytes=1 << 12)
    folder, groups = path.removeprefix("file:"), 0
    from pathlib import Path

    for file in Path(folder).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            for name in ("doc_id", "n_tokens", "offset"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings
            assert any(e.endswith("DICTIONARY") for e in columns["tokens.list.element"].encodings)
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert groups > 1
    picked = token_files.read(spark, path).filter("doc_id = 500").select("n_tokens")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema")[1].replace("n_tokens", "") and "EqualTo(doc_id,500)" in plan
    assert picked.count() == 1


def test_token_files_of_very_long_texts(spark, long_text, library):
    path = scratch.fresh_path(spark, "tokens")
    token_files.write(spark.createDataFrame([(2, long_text), (1, "a"), (3, None)], "doc_id long, text string"), path, shards=2)
    got = {r.doc_id: r.tokens for r in token_files.read(spark, path).collect()}
    assert got == {1: library.encode("a", add_special_tokens=False).ids + [1], 2: library.encode(long_text, add_special_tokens=False).ids + [1], 3: [1]}
