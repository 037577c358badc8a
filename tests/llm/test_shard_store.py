import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import mixing, scratch, shard_store


@pytest.fixture
def store(spark):
    return shard_store.Store(spark, scratch.fresh_path(spark, "store"), shard_store.Settings(target_bytes=1 << 16, base_bytes=1 << 12, fanout=3))


def rows(spark, start, n, size=20):
    """Texts that do not compress, so that bytes follow rows."""
    return spark.range(start, start + n, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(*[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(size)]).alias("text"))


def test_tiers(store):
    base, fanout = store.settings.base_bytes, store.settings.fanout
    for size in (0, 1, base - 1, base, base + 1, base * fanout - 1):
        assert store.tier(size) == 0
    assert [store.tier(base * fanout**k + 1) for k in range(5)] == [0, 1, 2, 3, 4]
    shards = [{"path": f"p{n}", "bytes": b} for n, b in enumerate([10, 20, 30, base * 4, base * 5, base * 16, base * 15, base * 14])]
    assert [[s["path"] for s in group] for group in store.due(shards)] == [["p0", "p1", "p2"]]  # two of a tier are too few, shards of half the target are done
    assert store.due(shards[:2]) == []


def test_files_are_dealt_out_by_bytes(store):
    group = [{"path": f"p{n:02d}", "bytes": b} for n, b in enumerate([9000, 1000, 8000, 2000] * 20)]
    files = [f for run in store._files(group) for f in run]
    size = {s["path"]: s["bytes"] for s in group}
    totals = [sum(size[p] for p in f) for f in files]
    assert sorted(p for f in files for p in f) == sorted(size) and len(files) == round(sum(size.values()) / (1 << 16))
    assert max(totals) - min(totals) <= 9000


def test_many_arrivals_become_files_of_the_target_size(spark, store):
    for n in range(24):
        store.append(rows(spark, 10 * n, 10 + n % 3))
        store.compact()
    shards = store.manifest()["shards"]
    sizes = sorted((s["bytes"] for s in shards), reverse=True)
    small = [b for b in sizes if 2 * b < store.settings.target_bytes]
    tiers = Counter(map(store.tier, small))
    assert max(tiers.values(), default=0) < store.settings.fanout  # no tier is due
    assert sizes[0] >= store.settings.target_bytes / 2 and sizes[0] <= 2 * store.settings.target_bytes
    assert store.read().count() == sum(10 + n % 3 for n in range(24))
    assert all(store.read(v).count() >= 0 for v in (1, store.version()))


def test_writers_at_the_same_time_lose_nothing(spark, store):
    errors = []

    def write(n):
        try:
            for k in range(3):
                store.append(rows(spark, 1000 * n + 10 * k, 10, 1))
                if n == 0:
                    try:
                        store.compact()
                    except shard_store.Conflict:
                        pass
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert Counter(r.doc_id for r in store.read().collect()) == Counter(1000 * n + 10 * k + i for n in range(4) for k in range(3) for i in range(10))


def test_both_ways_of_commit_refuse_a_number_that_is_taken(store):
    for way in (store._link, store._rename):
        target = store._path(f"manifests/{way.__name__}.json")
        for n in range(2):
            draft = store._path(f"manifests/.{way.__name__}{n}")
            store.fs.create(draft, False).close()
            assert way(draft, target) == (n == 0)
        assert store.fs.exists(target)


def test_a_number_is_given_once(store):
    results = []
    manifest = {"version": 1, "schema": None, "shards": []}
    threads = [threading.Thread(target=lambda: results.append(store._commit(manifest))) for _ in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert Counter(results) == {True: 1, False: 15} and store.version() == 1


def test_a_writer_that_dies_before_its_manifest_changes_nothing(spark, store):
    store.append(rows(spark, 0, 5))
    lost = store._write(rows(spark, 100, 5))  # data without a manifest
    assert store.read().count() == 5 and store.version() == 1
    store.vacuum()
    assert not store.fs.exists(store._path(lost[0]["path"])) and store.read().count() == 5


def test_a_merge_of_shards_that_are_gone_is_given_up(spark, store):
    for n in range(3):
        store.append(rows(spark, 10 * n, 10))
    group = [s["path"] for s in store.manifest()["shards"]]
    merged = store._write(store._read(group, store.manifest()["schema"]).coalesce(1))
    assert store.compact() == 1  # another writer was first
    with pytest.raises(shard_store.Conflict):
        store._change(None, merged, set(group))
    assert store.read().count() == 30


def test_very_long_texts(spark, store, long_text):
    df = spark.createDataFrame([(1, long_text, "s"), (2, "b", None), (2, "b", None)], "doc_id long, text string, source string")
    for _ in range(3):
        store.append(df)
    store.compact()
    assert Counter(r.text for r in store.read().collect()) == {long_text: 3, "b": 6}
    copies = mixing.replicate(df, exponent=1.0, total=12.0).collect()  # and mixing passes them on whole
    assert {r.text for r in copies} <= {long_text, "b"} and len(copies) > 3
