import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import hashing as H
from tokenloom.functions import merge as M
from tokenloom.functions import sql as S
from tokenloom.functions import text as X
from tokenloom.functions.decode import decode, token_bytes
from tokenloom.functions.search import below
from tokenloom.operators import encode as E
from tokenloom.operators import subwords
from tokenloom.plans import derived, queries
from tokenloom.sources.lines import normalize_file
from tokenloom.sources.tables import spread
from tokenloom.sources.vocab import Encoding, fetch_encoding, load_encoding, parse

PYTHON_PATTERN = re.compile(X.PATTERN.encode("latin-1").replace(rb"\x0B", b"\x0b"))
BYTES = len(derived.SPECIALS)
WORDS = ["th", "he", "in", "er", "an", "lo", "the", "hello", "an", "é"]
TEXTS = ["hello the inn", "snake_case", "don't we've", "é 日 x", "a  b\n\nc \n d", "\r\n", "\r\r\n", "x\0y", "", None, "thethethe", "<s>hello</s>", "q" * 200 + "th" * 60, "'T 's", "a b\u0085c\x0bd"]


@pytest.fixture(scope="module")
def encoding():
    tokens = derived.base_tokens() + WORDS
    return Encoding(tuple(tokens), {t: i for i, t in enumerate(derived.SPECIALS)})


def merged(data: bytes, e: Encoding) -> list[int]:
    """Repeatedly drop the right one of the leftmost pair of least rank."""
    s = list(range(len(data)))
    while True:
        ranks = [(e.encoder[bytes([data[a], data[b]])], i) for i, (a, b) in enumerate(zip(s, s[1:])) if bytes([data[a], data[b]]) in e.encoder]
        if not ranks:
            return s
        del s[min(ranks)[1] + 1]


def ordinary(text: str, e: Encoding) -> list[int]:
    out = []
    for p in PYTHON_PATTERN.findall(text.encode().split(b"\0")[0]):
        if p in e.encoder:
            out.append(e.encoder[p])
            continue
        s = merged(p, e)
        for i, j in zip(s, [*s[1:], len(p)]):
            out += [e.encoder[p[i:j]]] if p[i:j] in e.encoder else [e.encoder[bytes([b])] for b in p[i:j]]
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thein", max_size=40))
def test_heap_merge_is_the_rescan_merge(text):
    e = Encoding(tuple(derived.base_tokens() + WORDS), {})
    data = text.encode()
    assert M.merged_starts(data, e.pair_table) == merged(data, e)


def test_column_merge(spark, encoding):
    rng = random.Random(3)
    rows = [("".join(rng.choice("theinrlo") for _ in range(rng.randint(1, 20))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string").select("t", M.first_byte_merge(F.encode("t", "UTF-8"), encoding).alias("s"))
    for t, s in df.collect():
        assert s == merged(t.encode(), encoding)


def test_merge_query_takes_pieces_of_any_length(spark, tmp_path):
    words = ["the", "in", "thein" * 12 + "thei", "thein" * 13, "rlo" * 700, "7" * 65, " " * 66, "12" * 400]
    spark.createDataFrame([(n, f"{w}.") for n, w in enumerate(words)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    e, want = derived.of(spark, str(tmp_path)), {}
    for w in [*words, "."]:
        starts = merged(w.encode(), e)
        want[w.encode().hex().upper()] = " ".join(w[i:j].encode().hex().upper() for i, j in zip(starts, [*starts[1:], len(w)]))
    assert {r.hx: r.parts for r in queries.first_byte_merge(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("most", [E.MOST_PIECES, 3, 0])
def test_both_encoding_plans(spark, encoding, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_PIECES", most)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    for plan in ("rows", "columns"):
        got = dict(E.encode_ordinary(df, encoding, plan=plan, key="k").select("k", "tokens").collect())
        for k, t in enumerate(TEXTS):
            assert got[k] == (None if t is None else ordinary(t, encoding)), (plan, t)


@pytest.mark.parametrize("few, many", [((E.MOST_PIECES, 1), (E.MOST_PIECES, 20)), ((3, 20), (500, 20))])
def test_plan_in_columns_does_not_grow_with_its_pieces(spark, encoding, monkeypatch, few, many):
    """The driver keeps and describes plans; constants in them took all of its memory."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    texts = [*(" ".join(word(7919 * n) for n in range(k, k + 400)) for k in range(0, 4000, 200)), "", None]
    size = []
    for most, n in (few, many):
        monkeypatch.setattr(E, "MOST_PIECES", most)
        rows = list(enumerate(texts[:n] + texts[-2:]))
        coded = E.encode_ordinary(spark.createDataFrame(rows, "k int, text string"), encoding, plan="columns", key="k")
        size.append(len(coded._jdf.queryExecution().toString()))
        assert dict(coded.select("k", "tokens").collect()) == {k: None if t is None else ordinary(t, encoding) for k, t in rows}
    assert size[1] < size[0] + 10_000


def test_special_tokens(spark, encoding):
    df = spark.createDataFrame([("<s>hello</s>",), ("<s><pad>",), ("plain",)], "text string")
    get = lambda allowed: [r.tokens for r in E.encode(df, encoding, allowed).collect()]
    hello = encoding.encoder[b"hello"]
    assert get("all")[0] == [1, hello, 2]
    assert get(["<s>"])[1] == [1, 0]  # a part equal to any special token is that token
    assert get(None)[0] == ordinary("<s>hello</s>", encoding)
    assert get(["hello"])[0] == [1, hello, 2]
    assert get(["s>h"])[0] == ordinary("<", encoding) + ordinary("s>h", encoding) + ordinary("ello</s>", encoding)


def test_bytes_pieces_and_single_tokens(spark, encoding):
    df = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b"<s>"),), (bytearray(b""),), (bytearray(b"zz"),), (None,)], "data binary")
    e = encoding.encoder
    assert [r.token for r in E.encode_single_token(df, encoding).collect()] == [e[b"hello"], 1, 0, 0, None]
    assert E.encode_single_piece(df, encoding).first().tokens == [e[b"hello"]]
    assert E.encode_bytes(df, encoding).collect()[2].tokens == []
    assert E.encode_bytes(df, encoding).collect()[3].tokens == [e[b"z"]] * 2
    row = E.encode_unstable(spark.createDataFrame([("hello",)], "text string"), encoding).first().unstable
    assert row.tokens == [e[b"hello"]] and row.completions == []
    assert E.encode_unstable(spark.createDataFrame([("hello",)], "text string"), encoding, observed=True).first().unstable.tokens == []
    assert E.fallback_encode(spark.createDataFrame([("ab é!",)], "text string"), encoding).first().tokens == [e[b"a"], e[b"b"], e[b" "], e[b"!"]]  # é is a word character


def test_decode(spark, encoding):
    ids = [encoding.encoder[b"hello"], 1, 999_999, -1, BYTES + 0xC3]
    df = spark.createDataFrame([(ids,), ([],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(decode(F.col("t"), encoding)).collect()] == ["hello<s>�", "", None]
    # the literal took these bytes; the byte token's own id has none left
    shadowed = Encoding(tuple(derived.base_tokens() + ["e"]), {})
    one = spark.range(1).select(token_bytes(F.lit(BYTES + ord("e")), shadowed).alias("a"), token_bytes(F.lit(BYTES + 256), shadowed).alias("b")).first()
    assert (bytes(one.a), bytes(one.b)) == (b"", b"e") and shadowed.decoder[BYTES + ord("e")] == b"e"


def test_vocabulary_rules(tmp_path):
    e = parse('{"<s>": 0, "<0x41>": 1, "A": 2, "\\"": 3, "<0x123>": 4, "\'x\'": 5, "neg": -1, "<1>": 7}')
    assert e.encoder == {b"A": 2, b"x": 5} and e.decoder == {1: b"A", 2: b"A", 5: b"x"}
    assert e.specials == {"<s>": 0, "<1>": 7} and e.vocab_size == 4 and e.tokens[6] == ""
    with pytest.raises(ValueError):
        parse("no json")
    with pytest.raises(RuntimeError):
        parse('{"<s>": 0}')
    path = tmp_path / "v.model"
    path.write_text('{"a": 0}')
    assert load_encoding(str(path)).encoder == {b"a": 0}


def test_normalization(spark, tmp_path):
    rows = [("  Hello   World\t\n",), ("",), ("   ",), ("ÀB\0C",), ("end▁",), ("a\x0bb",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("t"))).collect()] == ["hello▁world", "", "", "Àb", "end", "a▁b", None]
    s = df.select(X.marker_stats(X.normalize_text(F.col("t"))).alias("s")).first().s
    assert (s.length, s.markers, s.characters) == (13, 1, 10)
    cut = spark.createDataFrame([("abcdef ghi",), ("abcde f",), ("abcdefghij",)], "t string").select(X.normalize_line(F.col("t"), 10)).collect()
    assert [bytes(r[0]) for r in cut] == [b"abcdef", b"abcde", b"abcdef"]
    (tmp_path / "in.txt").write_text("A b\n\nC  d\n")
    assert normalize_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out")) == 3
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "a▁b", "c▁d"]


def test_hashes(spark):
    inputs = [b"", b"hello", b"a", b"abc\0d", bytes(range(120, 140)), b"12345678"]
    signed = lambda d: [c - 256 if c > 127 else c for c in d.split(b"\0")[0]]

    def fold(codes, h, step):
        for c in codes:
            h = step(h, c) & 0xFFFFFFFF
        return h

    df = spark.createDataFrame([(bytearray(d),) for d in inputs], "d binary").select(H.djb2(F.col("d")), H.fnv1a(F.col("d")), H.sdbm(F.col("d")), H.murmur3(F.col("d")))
    got = [tuple(r) for r in df.collect()]
    for d, (a, b, c, _) in zip(inputs, got):
        assert a == fold(signed(d), 5381, lambda h, x: h * 33 + x)
        assert b == fold(d, 2166136261, lambda h, x: (h ^ x) * 16777619)
        assert c == fold(signed(d), 0, lambda h, x: h * 65599 + x)
    assert got[0] == (5381, 2166136261, 0, 0)
    assert got[1][3] == 0x248BFA47  # published test value of MurmurHash3 x86_32 with seed 0

    def int_hash(k):
        wrap = lambda v: (v + 2**31) % 2**32 - 2**31
        for _ in range(2):
            k = wrap(((k >> 16) ^ k) * 0x45D9F3B)
        return ((k >> 16) ^ k) % 2**32

    keys = [0, 1, -1, 12345, 2**31 - 1, -(2**31)]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k int").select(H.int_hash(F.col("k"))).collect()] == list(map(int_hash, keys))


def test_subwords(spark):
    rows = spark.createDataFrame([("un", 5, 1), ("##able", 3, 2), ("un", 7, 3), ("x" * 16, 1, 4), ("x" * 15, 1, 5), ("neg", -1, 6), ("", 1, 7), (None, 1, 8)], "token string, freq int, seq int")
    table = subwords.insert(None, rows, "seq")
    assert {tuple(r) for r in table.collect()} == {("un", 7), ("##able", 3), ("x" * 15, 1)}
    assert [r.token for r in subwords.listing(table).collect()] == ["##able", "un"]
    ask = spark.createDataFrame([("un",), ("nope",)], "token string")
    assert {tuple(r) for r in subwords.search(table, ask).collect()} == {("un", 7), ("nope", -1)}
    assert subwords.contains(table, ask).count() == 1 and subwords.count(table).first().tokens == 3
    assert subwords.remove(table, ask).count() == 2
    new = spark.createDataFrame([("un", 9), ("##able", -4), ("nope", 1)], "token string, freq int")
    assert {tuple(r) for r in subwords.update_frequency(table, new).collect()} == {("un", 9), ("##able", 3), ("x" * 15, 1)}
    vocab = spark.createDataFrame([(bytearray(b"b"),), (bytearray(b"ab"),), (bytearray(b"a"),)], "bytes binary")
    asked = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"ab"),), (bytearray(b"z"),)], "prefix binary")
    assert {bytes(r.prefix): r.place for r in subwords.find_prefix(vocab, asked).collect()} == {b"a": 0, b"ab": 1, b"z": None}


def test_sql_names_and_stream(spark, encoding, tmp_path):
    from tokenloom.streaming.stream import encode_each_batch, encode_stream

    S.register(spark)
    row = spark.sql("SELECT loom_normalize(' A  b ') AS n, loom_pieces('a_b c') AS p, loom_fnv1a(CAST('' AS BINARY)) AS h").first()
    assert (row.n, row.p, row.h) == ("a▁b", ["a", "b", " ", "c"], 2166136261)
    spark.createDataFrame([(1, "hello the"), (2, "")], "k int, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, text string").parquet(str(tmp_path / "in"))
    query = encode_stream(source, encoding).writeStream.format("memory").queryName("encoded").start()
    query.processAllAvailable()
    query.stop()
    want = {1: ordinary("hello the", encoding), 2: []}
    assert {r.k: r.tokens for r in spark.sql("SELECT * FROM encoded").collect()} == want
    found = {}
    query = encode_each_batch(source, encoding, "k", lambda df, _: found.update({r.k: r.tokens for r in df.collect()}), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert found == want


def test_small_tables_are_dealt_out_and_large_ones_left(spark):
    cores = spark.sparkContext.defaultParallelism
    small, large = spark.range(10, numPartitions=1), spark.range(10, numPartitions=cores + 1)
    assert spread(small).rdd.getNumPartitions() == cores
    assert spread(large) is large
    assert sorted(r.id for r in spread(small).collect()) == list(range(10))
    assert spread(small.limit(0)).count() == 0


@pytest.mark.parametrize("most", [E.MOST_PIECES, 3])
def test_encoding_with_null_keys_and_clashing_names(spark, encoding, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_PIECES", most)
    rows = [(n if n else None, t) for n, t in enumerate(TEXTS)]
    names = ["_key", "_tokens", "_ids", "_values", "tokens", "ids", "pos", "piece", "id", "data", "known", "all", "key", "bytes", "_plain", "_special"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "k int, text string, " + ", ".join(f"{n} string" for n in names))
    for plan in ("rows", "columns"):
        got = E.encode_ordinary(df, encoding, plan=plan, key="k")
        assert sorted(got.columns) == sorted(df.columns)
        for r in got.collect():
            assert r.tokens == (None if r.text is None else ordinary(r.text, encoding)), plan
            assert all(r[n] == n for n in names if n != "tokens")
    assert {(r.k, r._ids) for r in E.encode(df, encoding, "all").collect()} == {(k, "_ids") for k, _ in rows}
    token = E.encode_single_token(df.withColumn("v", F.encode("text", "UTF-8")), encoding, "v")
    assert {r._plain for r in token.collect()} == {"_plain"} and len(token.columns) == len(df.columns) + 2
    assert E.encode_unstable(df, encoding).first()._tokens == "_tokens"
    assert E.encode_ordinary(df.limit(0), encoding).count() == 0


def test_special_tokens_against_python(spark, encoding):
    """Quoted characters, allowed strings that are no tokens, and texts over several lines."""
    texts = ["<s>a\nb</s>", "a.b|c<s><s>", "the (x)\\E[the", "", None, "\0<s>x", "x\0y<s>z", "🙂<pad>🙂", "</s></s>"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    for allowed in ("all", "<s>", ["</s>", "<s>"], ["."], ["|", "(x)"], ["\\E["], ["the", "<pad>"], ["🙂"]):
        names = E.allowed_list(encoding, allowed)
        split = re.compile("(" + "|".join(map(re.escape, names)) + ")")
        for r in E.encode(df, encoding, allowed).collect():
            want = None if r.text is None else [i for p in split.split(r.text) if p for i in ([encoding.specials[p]] if p in encoding.specials else ordinary(p, encoding))]
            assert r.tokens == want, (allowed, r.text)


def test_fallback_against_python_classes(spark, encoding):
    pattern = re.compile(r"'s|'t|'re|'ve|'d|'ll|'m|[A-Za-z]+|\d+|\r?\n|\s+|[^\w\s]")
    old = unicodedata.ucd_3_2_0  # what has not changed since is the same in all tables
    same = [c for c in map(chr, range(0x3100)) if old.category(c) == unicodedata.category(c) != "Cn"]
    texts = ["".join(same[i : i + 256]) for i in range(0, len(same), 256)] + ["don't WE'LL ½ ٣٤ x\u3000y 🙂🙂 日本 e\u0301", None, ""]
    for r in E.fallback_encode(spark.createDataFrame([(t,) for t in texts], "text string"), encoding).collect():
        want = None
        if r.text is not None:
            want = [i for p in pattern.findall(r.text) for i in ([encoding.encoder[p.encode()]] if p.encode() in encoding.encoder else [encoding.encoder.get(bytes([b]), 0) for b in p.encode()])]
        assert r.tokens == want, r.text


def test_patterns_that_do_not_compile(spark):
    with pytest.warns(UserWarning, match="does not compile"):
        assert X.usable_pattern(spark, "([") == X.FALLBACK_PATTERN
    assert X.usable_pattern(spark, "[a-c]+") == "[a-c]+"
    row = spark.range(1).select(X.pieces(F.lit("snake_case 12!? é"), X.FALLBACK_PATTERN).alias("p")).first()
    assert row.p == ["snake", "_", "case", " ", "12", "!?", " ", "Ã©"]


def test_addresses_are_tried_in_order(tmp_path):
    (tmp_path / "bad").write_text("no json")
    (tmp_path / "one").write_text('{"a": 0}')
    (tmp_path / "two").write_text('{"b": 0}')
    url = lambda name: (tmp_path / name).as_uri()
    assert fetch_encoding(url("one")).encoder == {b"a": 0}
    assert fetch_encoding([url("gone"), url("bad"), url("two"), url("one")]).encoder == {b"b": 0}
    with pytest.raises(ValueError, match="no address"):
        fetch_encoding([url("gone"), url("bad")])
    with pytest.raises(ValueError):
        fetch_encoding([])


def test_tables_of_a_vocabulary(spark):
    e = parse('{"<s>": 0, "a": 2, "bc": 5}')
    assert [(r.id, r.token) for r in e.table(spark).orderBy("id").collect()] == [(0, "<s>"), (1, ""), (2, "a"), (3, ""), (4, ""), (5, "bc")]
    assert sorted(bytes(r.bytes) for r in e.byte_values(spark).collect()) == [b"<s>", b"a", b"bc"]


def test_long_lines_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    lines = [b"A" * n for n in (16381, 16382, 16383, 16384, 2 * 16383 - 1, 2 * 16383)] + ["é".encode() * 9000, b"x\0y", b"", b" ".join(bytes([rng.randint(97, 122)]) * 3 for _ in range(9000))]
    (tmp_path / "in.txt").write_bytes(b"\n".join(lines) + b"\n")
    want = []
    for line in lines:
        line += b"\n"
        for i in range(0, len(line), 16383):  # as a buffer of 16,384 bytes is filled
            part = line[i : i + 16383].removesuffix(b"\n").split(b"\0")[0].lower()
            want.append("▁".encode().join(part.split()))
    assert normalize_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out")) == len(want)
    got = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert got == b"".join(w + b"\n" for w in want)


def test_markers_as_observed(spark):
    rows = ["a▁b", "a▁b▁", "▁", "", "▁▁", None, "ab"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [tuple(r.s) for r in df.select(X.marker_stats(F.col("t"), observed=True).alias("s")).collect()]
    size = lambda t: len(t.encode())
    assert got == [(None, None, None) if t is None else (size(t), int(t.endswith("▁")), size(t) - 3 * t.endswith("▁")) for t in rows]
    at = df.select(*[X.is_space_marker(F.col("t"), n).alias(f"a{n}") for n in (0, 1, 3)]).collect()
    assert [tuple(r) for r in at[:3]] == [(False, False, False), (False, False, False), (True, False, False)]


def test_completions(spark):
    row = spark.range(1).select(X.add_completions(X.completions(), F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("c"), X.completions().alias("none")).first()
    assert row.c == [[1, 2], [3]] and row.none == []


def test_places_and_prefixes(spark):
    rng = random.Random(2)
    tokens = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 5))) for _ in range(200)})
    table = spark.createDataFrame([(bytearray(t),) for t in rng.sample(tokens, len(tokens))], "bytes binary").repartition(3)
    assert {bytes(r.bytes): r.place for r in subwords.sorted_tokens(table).collect()} == {t: n for n, t in enumerate(tokens)}
    asked = [b"", b"a", b"\xff", b"ab", b"abab", b"zz", b"a" * 9]
    found = subwords.find_prefix(table, spark.createDataFrame([(bytearray(p),) for p in asked], "prefix binary"))
    assert {bytes(r.prefix): r.place for r in found.collect()} == {p: next((n for n, t in enumerate(tokens) if t.startswith(p)), None) for p in asked}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("un", 5, 2), ("un", 9, 1)], "token string, freq int, seq int")
    base = spark.createDataFrame([("un", 1)], "token string, freq int")
    assert subwords.update_frequency(base, rows, "seq").first().freq == 5


def test_sql_names_with_a_vocabulary(spark, encoding):
    assert len(S.register(spark, encoding)) == 18
    spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string").createOrReplaceTempView("loom_texts")
    for r in spark.sql("SELECT n, loom_encode(t) AS ids, loom_token_count(t) AS k, loom_decode(loom_encode(t)) AS back, loom_merge(encode(t, 'UTF-8')) AS m FROM loom_texts").collect():
        t = TEXTS[r.n]
        assert r.ids == (None if t is None else ordinary(t, encoding))
        if t is not None:
            assert r.k == len(r.ids) and r.back == t.split("\0")[0].replace("_", "") and r.m == merged(t.encode(), encoding)
    one = spark.sql("SELECT loom_token_bytes(1) AS a, loom_token_bytes(-1) AS b, loom_decode_bytes(array(1, 99999)) AS c, loom_encode_piece(CAST('hello' AS BINARY)) AS d, loom_encode_bytes(CAST('zz' AS BINARY)) AS e").first()
    assert (bytes(one.a), bytes(one.b), bytes(one.c)) == (b"<s>", b"", b"<s>") and one.d == [encoding.encoder[b"hello"]] and len(one.e) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_binary_search(spark, n):
    cuts = sorted(v // 2 for v in range(n))
    rows = spark.range(-1, n + 2).select("id", *[below(F.lit(cuts) if cuts else F.array(), n, F.col("id"), e) for e in (False, True)]).collect()
    assert [tuple(r) for r in rows] == [(v, sum(c < v for c in cuts), sum(c <= v for c in cuts)) for v in range(-1, n + 2)]
