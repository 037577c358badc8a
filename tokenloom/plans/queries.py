"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from tokenloom.functions import hashing as H
from tokenloom.functions import merge as M
from tokenloom.functions import sql as S
from tokenloom.functions import text as X
from tokenloom.functions.decode import decode, token_bytes
from tokenloom.operators import encode as E
from tokenloom.operators import stats, subwords
from tokenloom.plans import derived
from tokenloom.sources.tables import table


def _joined(tokens: str = "tokens"):
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), " ").alias("ids")


def _hex(col):
    return F.hex(X.piece_bytes(col))


def vocab_facts(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    return spark.createDataFrame([(e.vocab_size, len(e.specials), len(e.encoder), len(e.decoder))], "vocab_size long, specials long, encoder long, decoder long")


def special_tokens(spark, sf_dir):
    return derived.of(spark, sf_dir).special_table(spark).select("token", F.col("id").cast("long").alias("id"))


def vocab_table(spark, sf_dir):
    return derived.of(spark, sf_dir).table(spark).filter("bytes IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.hex("bytes").alias("hx"))


def pretokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pieces(F.col("text"))).alias("pos", "piece")).select("doc_id", F.col("pos").cast("long").alias("pos"), _hex(F.col("piece")).alias("hx"))


def piece_counts(spark, sf_dir):
    return stats.piece_counts(table(spark, sf_dir, "documents")).select(_hex(F.col("piece")).alias("hx"), "n")


def piece_top_k(spark, sf_dir):
    return stats.top(piece_counts(spark, sf_dir), 10, "hx")


def whole_piece_lookup(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    counted = stats.piece_counts(table(spark, sf_dir, "documents"))
    vocab = F.broadcast(e.encoder_table(spark))
    return counted.join(vocab, X.piece_bytes(F.col("piece")) == F.col("bytes")).select(_hex(F.col("piece")).alias("hx"), F.col("id").cast("long").alias("id"), "n")


def first_byte_merge(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    size = F.octet_length("data")
    words = stats.piece_counts(table(spark, sf_dir, "documents")).select(X.piece_bytes(F.col("piece")).alias("data"))
    words = words.withColumn("long", M.long_merge(e)(F.when(size > M.SHORT, F.col("data"))))
    starts = F.when(size > M.SHORT, F.col("long")).otherwise(M.first_byte_merge(F.col("data"), e))
    return words.select(F.hex("data").alias("hx"), F.array_join(F.transform(M.parts(F.col("data"), starts), F.hex), " ").alias("parts"))


def encode_ordinary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.encode_ordinary(docs, derived.of(spark, sf_dir), plan="columns", key="doc_id").select("doc_id", _joined())


def encode_ordinary_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.encode_ordinary(docs, derived.of(spark, sf_dir)).select("doc_id", _joined())


def tokens_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return stats.tokens_by(E.encode_ordinary(docs, derived.of(spark, sf_dir)), "lang").select("lang", "docs", F.col("tokens").cast("long").alias("tokens"))


def encode_special_chat(spark, sf_dir):
    return E.encode(_turns(spark, sf_dir), derived.of(spark, sf_dir), "all").select("conv_id", "turn", _joined())


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<"), "role", F.lit(">"), "text", F.lit("<eot>")).alias("text"))


def encode_allowed_one(spark, sf_dir):
    return E.encode(_turns(spark, sf_dir), derived.of(spark, sf_dir), "<user>").select("conv_id", "turn", _joined())


def encode_allowed_list(spark, sf_dir):
    """The second one is no special token: the text is split there too."""
    return E.encode(_turns(spark, sf_dir), derived.of(spark, sf_dir), ["<eot>", "the"]).select("conv_id", "turn", _joined())


def completion_sets(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    coded = E.encode(_turns(spark, sf_dir), e, "all")
    found = X.add_completions(X.completions(F.col("tokens")), F.array(F.lit(e.specials["<eot>"])))
    ids = F.transform(found, lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), " "))
    return coded.select("conv_id", "turn", F.array_join(ids, "|").alias("completions"))


def _words(spark, sf_dir):
    return stats.piece_counts(table(spark, sf_dir, "documents")).select(X.piece_bytes(F.col("piece")).alias("data"))


def encode_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))
    return E.encode_bytes(rows, derived.of(spark, sf_dir)).select("item_id", _joined())


def encode_single_piece(spark, sf_dir):
    return E.encode_single_piece(_words(spark, sf_dir), derived.of(spark, sf_dir)).select(F.hex("data").alias("hx"), _joined())


def encode_single_token(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    asked = _words(spark, sf_dir).unionByName(e.special_table(spark).select(F.encode("token", "UTF-8").alias("data")))
    return E.encode_single_token(asked, e).select(F.hex("data").alias("hx"), F.col("token").cast("long").alias("token"))


def encode_unstable(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.encode_unstable(rows, derived.of(spark, sf_dir)).select("doc_id", _joined("unstable.tokens"), F.size("unstable.completions").cast("long").alias("n_completions"))


def fallback_encode(spark, sf_dir):
    return E.fallback_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), derived.of(spark, sf_dir)).select("doc_id", _joined())


def pretokenize_fallback(spark, sf_dir):
    """With a pattern that does not compile."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        pattern = X.usable_pattern(spark, "([A-Z")
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pieces(F.col("text"), pattern)).alias("pos", "piece"))
    return cut.select("doc_id", F.col("pos").cast("long").alias("pos"), _hex(F.col("piece")).alias("hx"))


def all_token_bytes(spark, sf_dir):
    return derived.of(spark, sf_dir).byte_values(spark).select(F.hex("bytes").alias("hx"))


def vocab_listing(spark, sf_dir):
    return derived.of(spark, sf_dir).table(spark).select(F.col("id").cast("long").alias("id"), "token")


def decode_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stats.round_trip(docs, derived.of(spark, sf_dir), "doc_id").select("doc_id", F.md5(F.encode("decoded", "UTF-8")).alias("decoded_md5"), "expected")


def decode_single_token(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    return spark.range(-1, len(e.tokens) + 2).select("id", F.hex(token_bytes(F.col("id"), e)).alias("hx"))


def token_frequency_topk(spark, sf_dir):
    coded = E.encode_ordinary(table(spark, sf_dir, "documents").select("text"), derived.of(spark, sf_dir))
    return stats.top(stats.token_frequencies(coded), 10, "token_id").select(F.col("token_id").cast("long").alias("token_id"), "n")


def compare_encodings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stats.compare(docs, {"derived": derived.of(spark, sf_dir), "bytes": derived.byte_encoding()})


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(X.normalize_text(F.col("text")), "UTF-8")).alias("normalized_md5"))


def normalize_stats(spark, sf_dir):
    s = X.marker_stats(X.normalize_text(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.col("s.length").cast("long").alias("length"), F.col("s.markers").cast("long").alias("markers"), F.col("s.characters").cast("long").alias("characters"))


def normalize_stats_observed(spark, sf_dir):
    s = X.marker_stats(X.normalize_text(F.col("text")), observed=True)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("length", "markers", "characters")])


def normalize_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.hex(X.normalize_line(F.col("text"), 16_384)).cast("binary")).alias("line_md5"))


def _hash(function):
    def query(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", function(F.encode("c_name", "UTF-8")).alias("h"))

    return query


def _hash_pieces(function):
    def query(spark, sf_dir):
        counted = stats.piece_counts(table(spark, sf_dir, "documents"))
        return counted.select(_hex(F.col("piece")).alias("hx"), function(X.piece_bytes(F.col("piece"))).alias("h"))

    return query


def hash_int(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", H.int_hash(F.col("c_custkey")).alias("h"))


def cache_hash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(H.cache_hash(F.col("c_custkey"), 64).alias("bucket")).agg(F.count("*").alias("n"))


def heap_hash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(H.heap_hash(F.encode("p_name", "UTF-8"), 64).alias("bucket")).agg(F.count("*").alias("n"))


def _trie(spark, sf_dir):
    counted = stats.piece_counts(table(spark, sf_dir, "benchmark"))
    return subwords.insert(None, counted.select(F.col("piece").alias("token"), F.col("n").alias("freq")))


def _asked(spark, sf_dir):
    counted = stats.piece_counts(table(spark, sf_dir, "documents"))
    return counted.select(F.col("piece").alias("token"))


def trie_list(spark, sf_dir):
    return subwords.listing(_trie(spark, sf_dir))


def trie_count(spark, sf_dir):
    return subwords.count(_trie(spark, sf_dir))


def trie_search(spark, sf_dir):
    return subwords.search(_trie(spark, sf_dir), _asked(spark, sf_dir))


def trie_contains(spark, sf_dir):
    return subwords.contains(_trie(spark, sf_dir), _asked(spark, sf_dir))


def trie_remove(spark, sf_dir):
    return subwords.remove(_trie(spark, sf_dir), _asked(spark, sf_dir))


def trie_update(spark, sf_dir):
    new = _asked(spark, sf_dir).select("token", (F.length("token") - 5).cast("long").alias("freq"))
    return subwords.update_frequency(_trie(spark, sf_dir), new)


def sorted_tokens(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    return subwords.sorted_tokens(e.encoder_table(spark)).select(F.hex("bytes").alias("hx"), F.col("place").cast("long").alias("place"))


def prefix_search(spark, sf_dir):
    e = derived.of(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.substring("text", 1, 3), "UTF-8").alias("prefix"))
    return subwords.find_prefix(e.encoder_table(spark), asked).select("doc_id", F.coalesce("place", F.lit(-1)).cast("long").alias("place"))


def sql_functions(spark, sf_dir):
    S.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("loom_documents")
    return spark.sql("SELECT doc_id, CAST(size(loom_pieces(text)) AS BIGINT) AS pieces, md5(CAST(loom_normalize(text) AS BINARY)) AS normalized_md5 FROM loom_documents")


def sql_hashes(spark, sf_dir):
    S.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("loom_customer")
    name = "encode(c_name, 'UTF-8')"
    hashes = ", ".join(f"loom_{h}({name}) AS {h}" for h in ("djb2", "fnv1a", "sdbm", "murmur3"))
    return spark.sql(f"SELECT c_custkey, {hashes}, loom_int_hash(c_custkey) AS int_hash, loom_cache_hash(c_custkey, 64) AS cache_hash, loom_heap_hash({name}, 64) AS heap_hash FROM loom_customer")


def sql_encoding(spark, sf_dir):
    S.register(spark, derived.of(spark, sf_dir))
    table(spark, sf_dir, "documents").createOrReplaceTempView("loom_documents")
    ids = "array_join(transform(tokens, t -> CAST(t AS STRING)), ' ') AS ids"
    return spark.sql(f"SELECT doc_id, {ids}, CAST(size(tokens) AS BIGINT) AS n_tokens, md5(encode(loom_decode(tokens), 'UTF-8')) AS decoded_md5 FROM (SELECT doc_id, loom_encode(text) AS tokens FROM loom_documents)")


QUERIES = {
    f.__name__: f
    for f in (
        vocab_facts, special_tokens, vocab_table, pretokenize, piece_counts, piece_top_k, whole_piece_lookup, first_byte_merge, encode_ordinary, encode_ordinary_rows,
        tokens_by_lang, encode_special_chat, encode_allowed_one, encode_allowed_list, completion_sets, encode_bytes, encode_single_piece, encode_single_token, encode_unstable, fallback_encode, decode_roundtrip, decode_single_token,
        token_frequency_topk, compare_encodings, normalize_text, normalize_stats, normalize_stats_observed, normalize_line, hash_int, cache_hash_buckets, heap_hash_buckets,
        trie_list, trie_count, trie_search, trie_contains, trie_remove, trie_update, sorted_tokens, prefix_search, sql_functions, sql_hashes, sql_encoding, pretokenize_fallback, all_token_bytes, vocab_listing,
    )
} | {
    "hash_djb2": _hash(H.djb2), "hash_fnv1a": _hash(H.fnv1a), "hash_sdbm": _hash(H.sdbm), "hash_murmur3": _hash(H.murmur3),
    "hash_djb2_pieces": _hash_pieces(H.djb2), "hash_fnv1a_pieces": _hash_pieces(H.fnv1a), "hash_sdbm_pieces": _hash_pieces(H.sdbm), "hash_murmur3_pieces": _hash_pieces(H.murmur3),
}
