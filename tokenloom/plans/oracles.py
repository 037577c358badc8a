"""SQL for the queries, written apart from the Spark code.

Pieces and tokens are held as upper-case hex of their bytes.
"""

from __future__ import annotations

from tokenloom.plans.derived import PAIRS, SPECIALS, WORDS

# The pieces' patterns as SQL literals, with RE2's classes.
PATTERN = r"""''s|''t|''re|''ve|''d|''ll|''m|[A-Za-z]+|[0-9]+|\r?\n|[ \t\n\x0B\f\r]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"""
PLAIN_PATTERN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+"
_WHITE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNICODE = rf"""''s|''t|''re|''ve|''d|''ll|''m|[A-Za-z]+|\p{{Nd}}+|\r?\n|[{_WHITE}]+|[^\pL\pN_{_WHITE}]"""
BYTES = len(SPECIALS)
EOT = SPECIALS.index("<eot>")


def pieces(name: str, table: str, keys: str) -> str:
    """CTEs name_raw (keys, pos, piece) and name (keys, pos, hx)."""
    return f"""
{name}_raw AS (SELECT {keys}, unnest(l) AS piece, generate_subscripts(l, 1) AS p FROM (SELECT {keys}, regexp_extract_all(text, '{PATTERN}') AS l FROM {table})),
{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY p, k) - 1 AS pos, hx FROM (
  SELECT {keys}, p, 0 AS k, hex(piece) AS hx FROM {name}_raw WHERE strlen(piece) = length(piece)
  UNION ALL SELECT {keys}, p, k, substr(hex(piece), 2 * CAST(k AS INT) + 1, 2) FROM {name}_raw, range(0, 4) t(k) WHERE strlen(piece) > length(piece) AND k < strlen(piece)))"""


VOCAB = f"""
{pieces("doc", "documents", "doc_id")},
letters AS (SELECT piece, count(*) AS n FROM doc_raw WHERE regexp_full_match(piece, '[A-Za-z]+') GROUP BY piece),
pair AS (SELECT substr(piece, CAST(i AS INT), 2) AS piece, sum(n) AS n FROM (SELECT piece, n, unnest(range(1, length(piece))) AS i FROM letters) GROUP BY 1),
vocab AS (SELECT {BYTES} + b AS id, upper(printf('%02x', b)) AS hx, printf('<0x%02X>', b) AS token FROM range(0, 256) t(b)
  UNION ALL SELECT {BYTES + 255} + rn, hex(piece), piece FROM (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS rn FROM pair) WHERE rn <= {PAIRS}
  UNION ALL SELECT {BYTES + 255 + PAIRS} + rn, hex(piece), piece FROM (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS rn FROM letters) WHERE rn <= {WORDS}),
enc AS (SELECT hx, max(id) AS id FROM vocab GROUP BY hx),
special AS (SELECT unnest(range(0, {BYTES})) AS id, unnest([{", ".join(f"'{s}'" for s in SPECIALS)}]) AS token)"""


def merged(source: str) -> str:
    """CTEs from ``source`` (a select of hx): parts (hx, k, part) and coded (hx, k, j, id)."""
    return f"""
asked AS (SELECT DISTINCT hx FROM ({source})),
step(hx, n, s) AS (SELECT hx, 0, range(0, length(hx) // 2) FROM asked
  UNION ALL SELECT hx, n + 1, s[1:bi] || s[bi + 2:] FROM (
    SELECT m.hx, m.n, m.s, arg_min(m.i, e.id * 1000000 + m.i) AS bi FROM (SELECT hx, n, s, unnest(range(1, len(s))) AS i FROM step) m
    JOIN enc e ON e.hx = substr(m.hx, CAST(2 * m.s[m.i] + 1 AS INT), 2) || substr(m.hx, CAST(2 * m.s[m.i + 1] + 1 AS INT), 2) GROUP BY m.hx, m.n, m.s)),
done AS (SELECT hx, arg_max(s, n) AS s FROM step GROUP BY hx),
parts AS (SELECT hx, k, substr(hx, CAST(2 * s[k] + 1 AS INT), CAST(2 * (coalesce(s[k + 1], length(hx) // 2) - s[k]) AS INT)) AS part FROM (SELECT hx, s, unnest(range(1, len(s) + 1)) AS k FROM done)),
coded AS (SELECT p.hx, k, 0 AS j, e.id FROM parts p JOIN enc e ON e.hx = p.part
  UNION ALL SELECT p.hx, k, j, e.id FROM (SELECT hx, k, part, unnest(range(0, length(part) // 2)) AS j FROM parts WHERE part NOT IN (SELECT hx FROM enc)) p
  JOIN enc e ON e.hx = substr(p.part, CAST(2 * j + 1 AS INT), 2))"""


def token_rows(name: str, keys: str) -> str:
    """CTE name_tokens (keys, pos, k, j, id) from the pieces ``name``; needs coded."""
    return f"""
{name}_tokens AS (SELECT {keys}, pos, 0 AS k, 0 AS j, e.id FROM {name} d JOIN enc e USING (hx)
  UNION ALL SELECT {keys}, pos, k, j, c.id FROM {name} d JOIN coded c USING (hx))"""


def missing(name: str) -> str:
    return f"SELECT hx FROM {name} WHERE hx NOT IN (SELECT hx FROM enc)"


DOC_TOKENS = f"WITH RECURSIVE {VOCAB}, {merged(missing('doc'))}, {token_rows('doc', 'doc_id')}"
WITH = f"WITH {VOCAB}"
IDS = "string_agg(CAST(id AS VARCHAR), ' ' ORDER BY {})"
LOWER = r"regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+', '▁', 'g')"
NORMAL = rf"regexp_replace({LOWER}, '▁\z', '')"
ENCODED = f"{DOC_TOKENS} SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN (SELECT doc_id, {IDS.format('pos, k, j')} AS ids FROM doc_tokens GROUP BY doc_id) USING (doc_id)"

BENCH = f"{VOCAB}, {pieces('ben', 'benchmark', 'item_id')}"
#: A token of the subword table is a piece with a character a byte, so each byte of 128 and more takes two bytes.
TOKENS = """
letter AS (SELECT upper(printf('%02x', b)) AS hx, chr(CAST(b AS INT)) AS c FROM range(1, 256) t(b)),
spelled AS (SELECT s.hx, string_agg(l.c, '' ORDER BY i) AS token FROM (SELECT hx, unnest(range(0, length(hx) // 2)) AS i FROM (SELECT hx FROM doc UNION SELECT hx FROM ben)) s
  JOIN letter l ON l.hx = substr(s.hx, CAST(2 * i + 1 AS INT), 2) GROUP BY s.hx)"""
TRIE = f"WITH {BENCH}, {TOKENS}, trie AS (SELECT token, count(*) AS freq FROM ben JOIN spelled USING (hx) WHERE strlen(token) <= 15 GROUP BY token)"

SIGNED = "list_transform(range(0, strlen({0})), lambda i: CAST(CASE WHEN CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INT), 2) AS BIGINT) >= 128 THEN CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INT), 2) AS BIGINT) - 256 ELSE CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INT), 2) AS BIGINT) END AS HUGEINT))"
PLAIN = "list_transform(range(0, strlen({0})), lambda i: CAST(CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INT), 2) AS BIGINT) AS HUGEINT))"
HEXED = "list_transform(range(0, length({0}) // 2), lambda i: CAST(CAST('0x' || substr({0}, CAST(2 * i + 1 AS INT), 2) AS BIGINT) AS HUGEINT))"
HEXED_SIGNED = "list_transform({}, lambda v: CASE WHEN v >= 128 THEN v - 256 ELSE v END)".format(HEXED)
M32 = "4294967296"


def fold(codes: str, seed: int, step: str) -> str:
    return f"CAST(list_reduce(list_prepend(CAST({seed} AS HUGEINT), {codes}), lambda h, c: {step}) AS BIGINT)"


DJB2 = f"(((h * 33 + c) % {M32}) + {M32}) % {M32}"
SDBM = f"(((h * 65599 + c) % {M32}) + {M32}) % {M32}"
FNV = f"(CAST(xor(CAST(h AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 16777619) % {M32}"


def rotate(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}) % {M32} + ({x}) // {1 << (32 - r)})"


def xor(a: str, b: str) -> str:
    return f"CAST(xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) AS HUGEINT)"


def murmur(codes: str, source: str, keys: str) -> str:
    """MurmurHash3 x86_32, seed 0, a step a CTE row."""
    mixed = f"({rotate(f'((w * {0xCC9E2D51}) % {M32})', 15)} * {0x1B873593}) % {M32}"
    return f"""WITH RECURSIVE src AS (SELECT DISTINCT {keys}, {codes} AS c FROM {source}),
word AS (SELECT {keys}, c, len(c) AS n, b, coalesce(c[4*b+1], 0) + coalesce(c[4*b+2], 0) * 256 + coalesce(c[4*b+3], 0) * 65536 + coalesce(c[4*b+4], 0) * 16777216 AS w
  FROM (SELECT {keys}, c, unnest(range(0, len(c) // 4 + 1)) AS b FROM src)),
mix AS (SELECT {keys}, n, b, {mixed} AS m FROM word),
run(key_, n, b, h) AS (SELECT {keys}, len(c), CAST(0 AS BIGINT), CAST(0 AS HUGEINT) FROM src
  UNION ALL SELECT key_, r.n, r.b + 1, ({rotate(xor("r.h", "m.m"), 13)} * 5 + {0xE6546B64}) % {M32} FROM run r JOIN mix m ON m.{keys} = r.key_ AND m.b = r.b WHERE r.b < r.n // 4),
tail AS (SELECT key_, {xor(f"CASE WHEN r.n % 4 <> 0 THEN {xor('r.h', 'm.m')} ELSE r.h END", "r.n")} AS h FROM run r JOIN mix m ON m.{keys} = r.key_ AND m.b = r.b WHERE r.b = r.n // 4),
f1 AS (SELECT key_, ({xor("h", "h // 65536")} * {0x85EBCA6B}) % {M32} AS h FROM tail),
f2 AS (SELECT key_, ({xor("h", "h // 8192")} * {0xC2B2AE35}) % {M32} AS h FROM f1)
SELECT key_ AS {keys}, CAST({xor("h", "h // 65536")} AS BIGINT) AS h FROM f2"""


def int_hash(key: str) -> str:
    wrap = lambda x: f"((({x}) + 2147483648) % {M32} + {M32}) % {M32} - 2147483648"
    k = f"CAST({key} AS BIGINT)"
    for _ in range(2):
        k = wrap(f"xor({k} >> 16, {k}) * 73244475")
    return f"(xor(({k}) >> 16, {k}) + {M32}) % {M32}"


#: Distinct pieces as hex.
DISTINCT = f"(WITH {pieces('doc', 'documents', 'doc_id')} SELECT DISTINCT hx FROM doc)"


def oracles() -> dict[str, str]:
    chat = f"WITH RECURSIVE {VOCAB}, {pieces('chat', 'conversations', 'conv_id, turn')}, {merged(missing('chat'))}, {token_rows('chat', 'conv_id, turn')}"
    bench = f"WITH RECURSIVE {BENCH}, "
    asked = "SELECT token FROM spelled WHERE hx IN (SELECT hx FROM doc)"
    docs = f"WITH RECURSIVE {VOCAB}, "
    user = f"WITH RECURSIVE {VOCAB}, said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text ELSE '<' || role || '>' || text END || '<eot>' AS text FROM conversations), {pieces('chat', 'said', 'conv_id, turn')}, {merged(missing('chat'))}, {token_rows('chat', 'conv_id, turn')}"
    split = f"""WITH RECURSIVE {VOCAB}, cut AS (SELECT conv_id, turn, string_split(replace(replace('<' || role || '>' || text || '<eot>', 'the', chr(1) || 'the' || chr(1)), '<eot>', chr(1) || '<eot>' || chr(1)), chr(1)) AS l FROM conversations),
said AS (SELECT conv_id, turn, n, l[n] AS text FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS n FROM cut) WHERE l[n] <> ''),
plain AS (SELECT * FROM said WHERE text NOT IN (SELECT token FROM special)), {pieces('chat', 'plain', 'conv_id, turn, n')}, {merged(missing('chat'))}, {token_rows('chat', 'conv_id, turn, n')},
every AS (SELECT conv_id, turn, n, pos, k, j, id FROM chat_tokens UNION ALL SELECT conv_id, turn, n, 0, 0, 0, s.id FROM said JOIN special s ON s.token = said.text)"""
    uni = f"""WITH {VOCAB}, uni AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '{UNICODE}') AS l FROM documents)),
own AS (SELECT doc_id, p, 0 AS k, e.id FROM uni JOIN enc e ON e.hx = hex(piece)
  UNION ALL SELECT doc_id, p, k, e.id FROM (SELECT doc_id, p, h, unnest(range(0, length(h) // 2)) AS k FROM (SELECT doc_id, p, hex(piece) AS h FROM uni) WHERE h NOT IN (SELECT hx FROM enc)) u JOIN enc e ON e.hx = substr(u.h, CAST(2 * k + 1 AS INT), 2))"""
    whole = IDS.format("k, j")
    stat = f"strlen({NORMAL})"
    marks = f"(strlen({NORMAL}) - strlen(replace({NORMAL}, '▁', ''))) // 3"
    return {
        "vocab_facts": f"{WITH} SELECT CAST((SELECT count(*) FROM enc) + {BYTES} AS BIGINT) AS vocab_size, CAST({BYTES} AS BIGINT) AS specials, (SELECT count(*) FROM enc) AS encoder, (SELECT count(*) FROM vocab) AS decoder",
        "special_tokens": f"{WITH} SELECT token, id FROM special",
        "vocab_table": f"{WITH} SELECT id, hx FROM vocab",
        "pretokenize": f"WITH {pieces('doc', 'documents', 'doc_id')} SELECT doc_id, pos, hx FROM doc",
        "piece_counts": f"WITH {pieces('doc', 'documents', 'doc_id')} SELECT hx, count(*) AS n FROM doc GROUP BY hx",
        "piece_top_k": f"WITH {pieces('doc', 'documents', 'doc_id')} SELECT hx, count(*) AS n FROM doc GROUP BY hx ORDER BY n DESC, hx LIMIT 10",
        "whole_piece_lookup": f"{WITH} SELECT hx, id, count(*) AS n FROM doc JOIN enc USING (hx) GROUP BY hx, id",
        "first_byte_merge": f"WITH RECURSIVE {VOCAB}, {merged('SELECT hx FROM doc')} SELECT hx, string_agg(part, ' ' ORDER BY k) AS parts FROM parts GROUP BY hx",
        "encode_ordinary": ENCODED,
        "encode_ordinary_rows": ENCODED,
        "tokens_by_lang": f"{DOC_TOKENS} SELECT lang, count(DISTINCT documents.doc_id) AS docs, count(id) AS tokens FROM documents LEFT JOIN doc_tokens USING (doc_id) GROUP BY lang",
        "encode_special_chat": f"{chat} SELECT conv_id, turn, concat_ws(' ', (SELECT s.id FROM special s WHERE s.token = '<' || role || '>'), ids, {EOT}) AS ids FROM conversations LEFT JOIN (SELECT conv_id, turn, {IDS.format('pos, k, j')} AS ids FROM chat_tokens GROUP BY conv_id, turn) USING (conv_id, turn)",
        "encode_bytes": f"{bench} {merged('SELECT hex(text) AS hx FROM benchmark')} SELECT item_id, {IDS.format('k, j')} AS ids FROM benchmark b JOIN coded c ON c.hx = hex(b.text) GROUP BY item_id",
        "encode_single_piece": f"{docs} {merged(missing('doc'))} SELECT hx, CAST(id AS VARCHAR) AS ids FROM (SELECT DISTINCT hx FROM doc) JOIN enc USING (hx) UNION ALL SELECT hx, {whole} FROM coded GROUP BY hx",
        "encode_single_token": f"{WITH} SELECT hx, coalesce(e.id, s.id, 0) AS token FROM (SELECT DISTINCT hx FROM doc UNION ALL SELECT hex(token) FROM special) LEFT JOIN enc e USING (hx) LEFT JOIN special s ON hex(s.token) = hx",
        "encode_unstable": f"{DOC_TOKENS} SELECT doc_id, coalesce(ids, '') AS ids, CAST(0 AS BIGINT) AS n_completions FROM documents LEFT JOIN (SELECT doc_id, {IDS.format('pos, k, j')} AS ids FROM doc_tokens GROUP BY doc_id) USING (doc_id)",
        "encode_allowed_one": f"{user} SELECT conv_id, turn, concat_ws(' ', CASE WHEN role = 'user' THEN (SELECT s.id FROM special s WHERE s.token = '<user>') END, ids) AS ids FROM conversations LEFT JOIN (SELECT conv_id, turn, {IDS.format('pos, k, j')} AS ids FROM chat_tokens GROUP BY conv_id, turn) USING (conv_id, turn)",
        "encode_allowed_list": f"{split} SELECT conv_id, turn, {IDS.format('n, pos, k, j')} AS ids FROM every GROUP BY conv_id, turn",
        "completion_sets": f"{chat} SELECT conv_id, turn, concat_ws(' ', (SELECT s.id FROM special s WHERE s.token = '<' || role || '>'), ids, {EOT}) || '|{EOT}' AS completions FROM conversations LEFT JOIN (SELECT conv_id, turn, {IDS.format('pos, k, j')} AS ids FROM chat_tokens GROUP BY conv_id, turn) USING (conv_id, turn)",
        "fallback_encode": f"{uni} SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN (SELECT doc_id, {IDS.format('p, k')} AS ids FROM own GROUP BY doc_id) USING (doc_id)",
        "pretokenize_fallback": f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, hex(unnest(l)) AS hx FROM (SELECT doc_id, regexp_extract_all(text, '{PLAIN_PATTERN}') AS l FROM documents)",
        "all_token_bytes": f"{WITH} SELECT hx FROM enc UNION ALL SELECT hex(token) FROM special",
        "vocab_listing": f"{WITH} SELECT i AS id, coalesce(s.token, v.token, '') AS token FROM range(0, (SELECT max(id) FROM vocab) + 1) t(i) LEFT JOIN special s ON s.id = i LEFT JOIN vocab v ON v.id = i",
        "decode_roundtrip": "SELECT doc_id, md5(replace(text, '_', '')) AS decoded_md5, true AS expected FROM documents",
        "decode_single_token": f"{WITH} SELECT i AS id, coalesce((SELECT hex(token) FROM special s WHERE s.id = i), (SELECT e.hx FROM enc e WHERE e.id = i), '') AS hx FROM range(-1, (SELECT max(id) FROM vocab) + 3) t(i)",
        "token_frequency_topk": f"{DOC_TOKENS} SELECT id AS token_id, count(*) AS n FROM doc_tokens GROUP BY id ORDER BY n DESC, id LIMIT 10",
        "compare_encodings": f"{DOC_TOKENS} SELECT 'derived' AS encoding, (SELECT count(*) FROM documents) AS docs, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS chars, (SELECT count(*) FROM doc_tokens) AS tokens UNION ALL SELECT 'bytes', (SELECT count(*) FROM documents), (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents), (SELECT CAST(sum(length(hx) // 2) AS BIGINT) FROM doc)",
        "normalize_text": f"SELECT doc_id, md5({NORMAL}) AS normalized_md5 FROM documents",
        "normalize_stats": f"SELECT doc_id, CAST({stat} AS BIGINT) AS length, CAST({marks} AS BIGINT) AS markers, CAST({stat} - 3 * ({marks}) AS BIGINT) AS characters FROM documents",
        "hash_int": f"SELECT c_custkey, CAST({int_hash('c_custkey')} AS BIGINT) AS h FROM customer",
        "cache_hash_buckets": f"SELECT CAST({int_hash('c_custkey')} AS BIGINT) % 64 AS bucket, count(*) AS n FROM customer GROUP BY 1",
        "heap_hash_buckets": f"SELECT {fold(SIGNED.format('p_name'), 5381, DJB2)} % 64 AS bucket, count(*) AS n FROM part GROUP BY 1",
        "hash_djb2": f"SELECT c_custkey, {fold(SIGNED.format('c_name'), 5381, DJB2)} AS h FROM customer",
        "hash_sdbm": f"SELECT c_custkey, {fold(SIGNED.format('c_name'), 0, SDBM)} AS h FROM customer",
        "hash_fnv1a": f"SELECT c_custkey, {fold(PLAIN.format('c_name'), 2166136261, FNV)} AS h FROM customer",
        "hash_murmur3": murmur(PLAIN.format("c_name"), "customer", "c_custkey"),
        "hash_djb2_pieces": f"SELECT hx, {fold(HEXED_SIGNED.format('hx'), 5381, DJB2)} AS h FROM {DISTINCT}",
        "hash_sdbm_pieces": f"SELECT hx, {fold(HEXED_SIGNED.format('hx'), 0, SDBM)} AS h FROM {DISTINCT}",
        "hash_fnv1a_pieces": f"SELECT hx, {fold(HEXED.format('hx'), 2166136261, FNV)} AS h FROM {DISTINCT}",
        "hash_murmur3_pieces": murmur(HEXED.format("hx"), DISTINCT, "hx"),
        "trie_list": f"{TRIE} SELECT token, freq FROM trie WHERE strlen(token) < 15",
        "trie_count": f"{TRIE} SELECT count(*) AS tokens FROM trie",
        "trie_search": f"{TRIE} SELECT token, coalesce(freq, -1) AS freq FROM ({asked}) LEFT JOIN trie USING (token)",
        "trie_contains": f"{TRIE} SELECT token FROM ({asked}) WHERE token IN (SELECT token FROM trie)",
        "trie_remove": f"{TRIE} SELECT token, freq FROM trie WHERE token NOT IN ({asked})",
        "trie_update": f"{TRIE} SELECT token, CASE WHEN token IN ({asked}) AND length(token) >= 5 THEN length(token) - 5 ELSE freq END AS freq FROM trie",
        "sorted_tokens": f"{WITH} SELECT hx, row_number() OVER (ORDER BY hx) - 1 AS place FROM enc",
        "prefix_search": f"{WITH}, place AS (SELECT hx, row_number() OVER (ORDER BY hx) - 1 AS place FROM enc), first AS (SELECT substr(hx, 1, CAST(2 * n AS INT)) AS p, min(place) AS place FROM place, range(0, 13) t(n) WHERE 2 * n <= length(hx) GROUP BY 1) SELECT doc_id, coalesce(first.place, -1) AS place FROM documents LEFT JOIN first ON p = hex(substr(text, 1, 3))",
        "normalize_line": f"SELECT doc_id, md5(CASE WHEN right(cut, 6) = 'E29681' THEN left(cut, length(cut) - 6) ELSE cut END) AS line_md5 FROM (SELECT doc_id, substr(h, 1, 2 * CASE WHEN substr(h, 32759, 6) = 'E29681' THEN 16382 WHEN substr(h, 32757, 6) = 'E29681' THEN 16381 ELSE 16380 END) AS cut FROM (SELECT doc_id, hex({LOWER}) AS h FROM documents))",
        "normalize_stats_observed": f"SELECT doc_id, CAST({stat} AS BIGINT) AS length, CAST(CASE WHEN ends_with({NORMAL}, '▁') THEN 1 ELSE 0 END AS BIGINT) AS markers, CAST({stat} - CASE WHEN ends_with({NORMAL}, '▁') THEN 3 ELSE 0 END AS BIGINT) AS characters FROM documents",
        "sql_functions": f"WITH {pieces('doc', 'documents', 'doc_id')} SELECT doc_id, coalesce(n, 0) AS pieces, md5({NORMAL}) AS normalized_md5 FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id) USING (doc_id)",
        "sql_hashes": f"SELECT c_custkey, {fold(SIGNED.format('c_name'), 5381, DJB2)} AS djb2, {fold(PLAIN.format('c_name'), 2166136261, FNV)} AS fnv1a, {fold(SIGNED.format('c_name'), 0, SDBM)} AS sdbm, m.h AS murmur3, CAST({int_hash('c_custkey')} AS BIGINT) AS int_hash, CAST({int_hash('c_custkey')} AS BIGINT) % 64 AS cache_hash, {fold(SIGNED.format('c_name'), 5381, DJB2)} % 64 AS heap_hash FROM customer JOIN ({murmur(PLAIN.format('c_name'), 'customer', 'c_custkey')}) m USING (c_custkey)",
        "sql_encoding": f"{DOC_TOKENS} SELECT doc_id, coalesce(ids, '') AS ids, coalesce(n, 0) AS n_tokens, md5(replace(text, '_', '')) AS decoded_md5 FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, {IDS.format('pos, k, j')} AS ids FROM doc_tokens GROUP BY doc_id) USING (doc_id)",
    }
