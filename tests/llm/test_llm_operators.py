import hashlib
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import bpe, bpe_codec, components, exact_dedup, mixing, quality_rules, scratch, shard_store, simhash_dedup, token_files, weak_labels
from tokenloom.llm import words as W

DATA = "/root/testdata/sf0.001"
#: Nulls, empty and odd texts, ties, repeated rows, a long text, and a column with a name that operators use.
ODD = [
    (1, "a b c d"), (2, None), (3, ""), (4, "a b c d"), (4, "a b c d"), (5, " \t\n"), (6, "word " * 3000), (None, "a b c d"), (None, None), (7, "Don't WE'LL <|endoftext|> É̀ 日本 x\x1cy"),
    (8, "one"), (9, "The quick brown fox jumps over the lazy dog, and then it rests.\n" * 3), (10, "Ünïcode ßtraße ＡＢＣ 123 ½ 🙂🙂"),
]
SCHEMA = "doc_id long, text string, source string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if n % 3 else "s", "x") for n, (i, t) in enumerate(ODD)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return bpe.load(open(bpe.default_path(), encoding="utf-8").read())


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text or "" for r in documents(spark).collect()}


def test_speculation_and_exact_merging_match_the_library(library):
    source = open(bpe.default_path(), encoding="utf-8").read()
    ours, rng = bpe_codec.SpeculativeBpe(source), random.Random(5)
    stems = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii()]
    pieces = {"".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(4000)} | {"a" * n for n in range(1, 40)}
    pieces = sorted(p for p in pieces if p)
    want = [[t.id for t in library.model.tokenize(p)] for p in pieces]
    assert ours.encode_pieces(pieces) == want
    assert [ours.exact(p) for p in pieces] == want
    assert ours.exact_all(pieces) == want and ours.exact_all([]) == [] and ours.exact_all(["", "a"]) == [[], ours.exact("a")]
    odd = ["ab" * 16, "the" * 30, "x" * 64, "y" * 65, "zq" * 200, "日本", "a日", "\u0123\u0124b"]  # of all widths, longer, and with letters that are no tokens
    assert ours.exact_all(odd) == [ours.exact(p) for p in odd]
    letters = [*bpe.LETTERS.values()]
    random_pieces = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    assert ours.exact_all(random_pieces) == [[t.id for t in library.model.tokenize(p)] for p in random_pieces]


def test_small_slices_change_nothing(library):
    column = pa.array([t for _, t in ODD] * 3)
    batch = pa.record_batch([column], names=["text"])
    codec = bpe_codec.Codec(open(bpe.default_path(), encoding="utf-8").read())
    for limit in (1, 50, 1 << 20):
        ids, prints = [], []
        for part in W.slices(batch, "text", limit):
            bounds, found = codec.chunks.encode(part.column("text"))
            ids += [found[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
            prints += simhash_dedup.fingerprints(part.column("text")).tolist()
        assert ids == [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert prints == [fingerprint(t or "") for t in column.to_pylist()]


def test_codec(spark, odd, empty, library):
    rows = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe_codec.digests(odd).collect()}
    want = set()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert rows == want
    assert bpe_codec.digests(empty).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(odd)).filter("doc_id = 1").first()
    assert back.decoded == "a</w> b</w> c</w> d</w>" and back.kept == "x"


def test_codec_of_very_long_texts(spark, long_text, library):
    row = bpe_codec.digests(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).first()
    ids = library.encode(long_text, add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"decoder": {"type": "ByteLevel"}}])
def test_other_tokenizer_files_are_refused(spark, odd, tmp_path, change):
    path = tmp_path / "other.json"
    path.write_text(json.dumps(json.load(open(bpe.default_path(), encoding="utf-8")) | change))
    for use in (lambda: bpe_codec.digests(odd, str(path)), lambda: bpe_codec.encode(odd, tokenizer_path=str(path)), lambda: token_files.write(odd, str(tmp_path / "out"), tokenizer_path=str(path))):
        with pytest.raises(ValueError):
            use()


def test_token_files(spark, odd, empty, library):
    path = scratch.fresh_path(spark, "tokens")
    token_files.write(documents(spark), path, shards=3)
    got, before = {r.doc_id: r for r in token_files.documents(spark, path).collect()}, 0
    for i, t in sorted(texts(spark).items()):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert token_files.read(spark, path).filter("doc_id = 5").select("tokens").first().tokens[-1] == 1
    for table in (odd, empty):
        path = scratch.fresh_path(spark, "tokens")
        token_files.write(table, path)
        rows = sorted(token_files.documents(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in table.collect()), key=lambda x: (x is not None, x or 0))
        assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def base_counts(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(line.encode().split()) and line in seen
        seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), again, r, n < 20 or 100 * r > 30 * n


def test_quality_rules(spark, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs, known = documents(spark), texts(spark)
    rows = quality_rules.verdicts(docs, labels).collect()
    assert len(rows) == len(known)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(known[r.doc_id])
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.Settings().threshold)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[r.doc_id], r.kept) for r in rows if r.doc_id in quality and not r.base_failed]
    assert all(k for q, k in judged if q) and not any(k for q, k in judged if not q)
    for r in quality_rules.verdicts(odd, labels.limit(0)).collect():
        assert r.llr == 0 and r.kept == (not r.base_failed)
    assert quality_rules.keep(odd, labels).columns == odd.columns
    assert quality_rules.keep(empty, labels).count() == 0


def test_weak_labels_held_out(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = weak_labels.classify(docs).join(labels, "doc_id").collect()  # the labels took no part
    assert np.mean([r.kept for r in rows if r.quality]) > 0.98
    assert np.mean([not r.kept for r in rows if not r.quality]) > 0.9
    assert weak_labels.classify(odd).count() == len(ODD) and weak_labels.keep(odd).columns == odd.columns
    assert weak_labels.classify(empty).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng, k, n = np.random.default_rng(1), len(weak_labels.LABELLERS), 20_000
    truth, right = rng.random(n) < 0.7, np.linspace(0.6, 0.95, k)
    v = np.where(rng.random((n, k)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, count = np.unique(weak_labels.pattern(v), return_counts=True)
    post, prior, table = weak_labels.expectation_maximisation(weak_labels.unpack(patterns), count)
    assert abs(prior[0] - 0.7) < 0.03
    assert np.allclose(list(weak_labels.accuracies(table).values()), right, atol=0.03)


def test_exact_dedup(spark, odd, empty, monkeypatch):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest(), best(groups[t or ""]), len(groups[t or ""])) for i, t in ODD)
    for repeats in (exact_dedup.REPEATS, 1):
        monkeypatch.setattr(exact_dedup, "REPEATS", repeats)
        rows = exact_dedup.verdicts(odd).collect()
        assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in rows) == want
        assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({h for _, h, _, _ in want})
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = exact_dedup.keep(odd).collect()
    assert sorted((r.text or "") for r in left) == sorted(groups) and left[0].kept == "x"
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.keep(empty).count() == 0


def test_exact_dedup_sql_on_odd_rows(spark, odd, tmp_path):
    """Repeats, null ids and texts, one id far from the others."""
    table = odd.unionByName(odd.limit(4)).unionByName(spark.createDataFrame([(1 << 60, "a b c d", None, None)] * 3 + [(None, "only", None, None)] * 2, SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = exact_dedup.query(spark, str(tmp_path)).collect(), con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.SQL})").fetchall()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(want)


def test_survivors_of_repeated_rows_do_not_depend_on_the_order(spark):
    rows = [(1, "a b c", f"s{n}", "x") for n in range(20)] + [(2, "a b c", "t", "x"), (3, "q r s t", "u", None), (3, "q r s t", "u", "y")]
    rows += [(None, "n n n n", f"v{n}", None) for n in range(5)]
    for keep in (exact_dedup.keep, simhash_dedup.keep):
        got = [sorted(map(str, keep(spark.createDataFrame(random.Random(n).sample(rows, len(rows)), SCHEMA).repartition(n + 1)).collect())) for n in range(3)]
        assert got[0] == got[1] == got[2] and len(got[0]) == 3


def test_dedup_of_very_long_texts(spark, long_text):
    rows = [(1, long_text), (2, long_text + "."), (3, long_text), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(df).collect()) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]
    prints = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.classes(df).collect()}
    assert prints == {i: (fingerprint(t), 4 if i == 4 else 1) for i, t in rows}


def test_columns_with_names_that_operators_use(spark):
    names = ["_id", "_sha", "_key", "_text", "_source", "_parts", "_cdf", "_salt", "_count", "_number", "_copy", "_order", "parts", "cdf", "w", "n", "copy", "ORDER_KEY", "ids", "digest", "fp", "text_key", "component_id", "llr", "h"]
    rows = [(i, f"a b c {i % 3}", "s") for i in range(8)] + [(9, None, "s"), (9, "", "s")]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    plain, labels = df.select("doc_id", "text", "source"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for keep in (exact_dedup.keep, simhash_dedup.keep, mixing.mix, weak_labels.keep, lambda d: quality_rules.keep(d, labels)):
        got = keep(df)
        assert got.columns == df.columns
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, keep(plain).collect()))
        assert all(r._id == "_id" and r.cdf == "cdf" and r.ORDER_KEY == "ORDER_KEY" for r in got.collect())
    assert exact_dedup.keep(df).filter("doc_id = 9").count() == 1  # null counts as empty
    got = mixing.replicate(df)
    assert [c for c in got.columns if c.lower() in ("copy", "order_key")] == ["copy", "order_key"]
    assert {(r.doc_id, r.copy, r.order_key) for r in got.collect()} == {(r.doc_id, r.copy, r.order_key) for r in mixing.replicate(plain).collect()}
    assert sorted(r.ids for r in bpe_codec.encode(df).collect()) == sorted(r.ids for r in bpe_codec.encode(plain).collect())


def test_mixing_many_sources(spark, monkeypatch):
    """The join over salts gives what the broadcast gives."""
    df = spark.createDataFrame([(i, f"t{i}", [None, "a", "b"][i % 3]) for i in range(300)], "doc_id long, text string, source string")
    want = {tuple(r) for r in mixing.replicate(df).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert {tuple(r) for r in mixing.replicate(df).collect()} == want


def test_perfect_hash():
    rng = np.random.default_rng(2)
    digests = rng.integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    f = exact_dedup.PerfectHash.build(digests)
    assert sorted(f.slots(digests).tolist()) == list(range(5000))
    assert f.slots(rng.integers(0, 1 << 63, (1000, 4)).astype(np.uint64)).max() < 5000


def fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def reached(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_on_documents(spark):
    known = texts(spark)
    prints = {i: fingerprint(t) for i, t in known.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(known), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = reached(links, known)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.query(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in known}
    assert {r.doc_id for r in simhash_dedup.keep(documents(spark)).collect()} == set(want.values())


def test_every_link_is_found(spark):
    """Clusters round a few centres."""
    rng, prints = random.Random(4), set()
    for size in (300, 40, 5):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(size)}
    prints |= {rng.getrandbits(64) for _ in range(200)} | {sum(1 << b for b in s) for s in itertools.combinations(range(24), 2)} | {0}
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p, n) for n, p in enumerate(prints)]
    links = simhash_dedup.links(spark.createDataFrame(rows, "fp long, rep long"))
    number = dict(rows)
    root = {number[r.node]: number[r.component] for r in components.components(links).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want, got, sets = reached(pairs, range(len(prints))), defaultdict(set), defaultdict(set)
    for n in want:
        got[root.get(n, n)].add(n)
        sets[want[n]].add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, sets.values()))


def test_fingerprints_without_an_id_link_too(spark, monkeypatch):
    """Near to an id, between two ids, alone together; and two texts of one id."""
    rows = [(5, 0b0), (None, 0b11), (9, 0b1111 << 40), (None, 0b111111 << 40), (8, 0xFF << 40), (None, 0xFFFF << 20), (None, 0xFFFFF << 20 >> 2), (3, 0xABCDEF << 8), (3, 0x123456 << 30), (7, 0x123457 << 30)]
    prints = sorted({p for _, p in rows})
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2] + [(0x123456 << 30, 0xABCDEF << 8)]
    roots, names = reached([tuple(sorted(k)) for k in links], prints), {}
    for i, p in rows:
        if i is not None:
            names[roots[p]] = min(i, names.get(roots[p], i))
    df = spark.createDataFrame([(i, p, p) for i, p in rows], "doc_id long, text_key long, fp long")
    monkeypatch.setattr(simhash_dedup, "signatures", lambda docs: docs)
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash_dedup.classes(df).collect()}
    assert got == {(i, p, names.get(roots[p])) for i, p in rows}
    assert {(None, 0b11, 5), (9, 0b1111 << 40, 8), (None, 0xFFFF << 20, None), (7, 0x123457 << 30, 3)} <= got


def test_tallies_are_the_shared_positional_bytes():
    rng = np.random.default_rng(3)
    u = rng.integers(0, 256, (20_000, 8), np.uint8)
    v = np.where(rng.random((20_000, 8)) < 0.3, rng.integers(0, 256, (20_000, 8), np.uint8), u)
    got = simhash_dedup.tally(u.view(np.uint64).ravel(), np.ascontiguousarray(v).view(np.uint64).ravel())
    assert got.tolist() == (u == v).sum(axis=1).tolist() and len(set(got.tolist())) > 6
    # every two bytes that may differ are left out together by a list
    assert {tuple(sorted(set(range(8)) - set(s))) for s in simhash_dedup.SETS} == set(itertools.combinations(range(8), 2))


def test_many_fingerprints_that_agree_in_five_bytes(spark):
    """A hundred thousand dealt over many lists; and a list with all values of fourteen bits."""
    rng = np.random.default_rng(5)
    wide = np.unique(rng.integers(0, 1 << 24, 100_000)) << 16 | 0x7A << 48
    whole = np.arange(1 << 14) << 32 | 0x11 << 56
    found = simhash_dedup.links(spark.createDataFrame(pa.table({"fp": np.concatenate((wide, whole))}))).toPandas().to_numpy()
    node, root = components.local_roots(found[:, 0], found[:, 1])
    assert len(set(root[np.isin(node, whole)])) == 1 and np.isin(whole, node).all()
    at, known = dict(zip(node.tolist(), root.tolist())), set(wide.tolist())
    masks = {1 << a | 1 << b for a in range(16, 40) for b in range(16, 40)}
    linked = [(p, p ^ m) for p in wide[:500].tolist() for m in masks if p ^ m in known]
    assert len(linked) > 100 and all(at[p] == at[q] for p, q in linked)


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_simhash_odd(spark, odd, empty):
    rows = simhash_dedup.classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    assert sorted(r.doc_id or 0 for r in simhash_dedup.keep(odd).collect()) == sorted({r.component_id for r in rows})
    assert simhash_dedup.classes(empty).count() == 0 and simhash_dedup.keep(empty).count() == 0


def test_mixing(spark, odd, empty):
    rows = [(i, f"t{i}", "big" if i % 4 else "small", "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.replicate(df, weights={"big": 0.5, "small": 0.5}).collect()
    count = Counter(r.source for r in got)
    assert abs(count["big"] - 2000) < 200 and abs(count["small"] - 2000) < 200
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.replicate(df.repartition(7), weights={"big": 0.5, "small": 0.5}).collect()}
    rare = mixing.replicate(df.filter("doc_id < 8"), total=1600.0, exponent=0.0).groupBy("doc_id").count().collect()
    assert len(rare) == 8 and abs(sum(r["count"] for r in rare) - 1600) < 200  # a mean above one part
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_shard_store(spark, odd, empty):
    store = shard_store.Store(spark, scratch.fresh_path(spark, "store"), shard_store.Settings(target_bytes=1 << 20, base_bytes=1 << 10, fanout=3))
    for i in range(4):
        store.append(odd.withColumn("n", F.lit(i)))
    many = len(store.manifest()["shards"])
    assert store.compact() >= 1 and len(store.manifest()["shards"]) < many
    store.append(empty.withColumn("n", F.lit(9)))
    old = store.read(4).count()
    store.vacuum()
    assert store.read().count() == old == 4 * len(ODD)
    assert {c for c, _ in store.read().dtypes} == {*odd.columns, "n"}
    taken = store.manifest()
    assert not store._commit(taken)  # the version is there already
    with pytest.raises(shard_store.Conflict):
        store._change(None, [], {"data/gone"})


def test_shard_store_keeps_columns_of_later_arrivals(spark):
    store = shard_store.Store(spark, scratch.fresh_path(spark, "store"), shard_store.Settings(fanout=2))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 7)], "doc_id long, text string, score int"))
    store.append(spark.createDataFrame([(3, "en")], "doc_id long, lang string"))
    want = {(1, "a", None, None), (2, "b", 7, None), (3, None, None, "en")}
    assert store.read().columns == ["doc_id", "text", "score", "lang"] and {tuple(r) for r in store.read().collect()} == want
    assert store.compact() >= 1
    store.vacuum()
    assert {tuple(r) for r in store.read().collect()} == want
    version = store.version()
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("4",)], "doc_id string"))
    assert store.version() == version


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_shard_store", "op5_quality_rules", "op8_exact_dedup", "op10_source_mixing"])
def test_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).to_numpy()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark, library):
    """Each stage on what the one before kept, against plain Python."""
    docs = documents(spark)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.verdicts(docs, labels).collect()}
    kept = {i: t for i, t in texts(spark).items() if verdict[i]}
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    kept = {i: kept[i] for i in last.values()}
    prints = {i: fingerprint(t) for i, t in kept.items()}
    roots = reached([(a, b) for a, b in itertools.combinations(sorted(kept), 2) if (prints[a] ^ prints[b]).bit_count() <= 2], kept)
    kept = {i: kept[i] for i in set(roots.values())}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert len(out) > 100 and {r.doc_id for r in out} <= set(kept)
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(kept[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    table = scratch.materialise(docs.filter(F.col("doc_id").isin(*kept)), "kept")
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixing.mix(table).collect())
