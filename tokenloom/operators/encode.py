"""Encoding: texts, byte strings and single tokens to ids.

Texts are cut into pieces by columns; a piece is a string with one character a
byte. ``encode_ordinary`` has two plans with equal results. ``rows`` hands each
Arrow batch of pieces to a Python worker, which codes the batch's distinct pieces
and gathers their ids by offsets: no loop over rows, no shuffle, any key, batch or
stream. ``columns`` stays in the JVM: distinct pieces are counted, and the
``MOST_PIECES`` most frequent that are no tokens are merged once. With the vocabulary
they are one value of hash buckets, a scalar subquery, in which each row looks its
pieces up: the plan and its description do not grow with them. If there are rarer
pieces, only those are exploded, merged once, gathered by key and joined to their
rows; the pieces that would be hot keys are not among them.

A result column replaces one of its name. A null value gives a null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import merge
from tokenloom.functions import text as X
from tokenloom.functions.search import below
from tokenloom.names import unused
from tokenloom.sources.vocab import Encoding

#: Distinct pieces that a worker remembers before it starts anew.
CACHE_PIECES = 200_000
#: Merged pieces that the plan ``columns`` sends out, some 50 bytes each.
MOST_PIECES = 100_000
#: Elements that a list can have.
MOST_VALUES = 2**31 - 1
#: Before the name of a special token among pieces, which have no such character.
SPECIAL = "\ue000"


class PieceCoder:
    """Ids of pieces on a Python worker, each distinct piece worked out once."""

    def __init__(self, encoding: Encoding):
        self.encoder, self.byte_ids, self.pairs = encoding.encoder, encoding.byte_ids, encoding.pair_table
        self.specials = encoding.specials
        self.known: dict[bytes, list[int]] = {}

    def spelled(self, data: bytes) -> list[int]:
        return [self.byte_ids[b] for b in data]

    def merged(self, data: bytes) -> list[int]:
        if len(data) < 2:
            return self.spelled(data)
        starts = merge.merged_starts(data, self.pairs)
        parts = [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)])]
        return [i for p in parts for i in ([self.encoder[p]] if p in self.encoder else self.spelled(p))]

    def piece(self, data: bytes) -> list[int]:
        found = self.known.get(data)
        if found is None:
            whole = self.encoder.get(data)
            found = [whole] if whole is not None else self.merged(data)
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[data] = found
        return found

    def whole_or_spelled(self, data: bytes) -> list[int]:
        whole = self.encoder.get(data)
        return [whole] if whole is not None else self.spelled(data)

    def marked(self, piece: str) -> list[int]:
        return [self.specials[piece[1:]]] if piece[:1] == SPECIAL else self.piece(piece.encode("latin-1"))


def _gathered(df: DataFrame, out: str, encoding: Encoding, values: Column, ids_of: Callable[[PieceCoder, str | bytes], list[int]]) -> DataFrame:
    """``df`` with the ids of a column of values, or of lists of them: one after the other for each row."""
    others = [c for c in df.columns if c.lower() != out.lower()]
    (extra,) = unused(df, "_values")
    given = df.select(*[df[c] for c in others], values.alias(extra))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(encoding)
        for batch in batches:
            column = batch.column(len(others))
            lists = pa.types.is_list(column.type)
            each = column.flatten() if lists else column
            coded = each.dictionary_encode()
            found = [ids_of(coder, v) for v in coded.dictionary.to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            pool = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            at = coded.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)  # a null value has no ids
            size, start = np.append(size, 0), np.append(np.cumsum(size) - size, 0)
            lengths = size[at]
            ends = np.cumsum(lengths)
            ids = pool[np.repeat(start[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
            bounds = np.concatenate(([0], ends))
            if lists:
                offsets = column.offsets.to_numpy()
                bounds = bounds[offsets - offsets[0]]
            made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=column.is_null() if column.null_count else None)
            yield pa.record_batch([*batch.columns[: len(others)], made], names=schema.names)

    return given.mapInArrow(run, schema)


def encode_ordinary(df: DataFrame, encoding: Encoding, text: str = "text", out: str = "tokens", plan: str = "rows", key: str | None = None) -> DataFrame:
    """``df`` with the ids of its texts. The plan ``columns`` needs a unique ``key``; one null counts as a key."""
    if plan == "rows":
        return _gathered(df, out, encoding, X.pieces(df[text]), PieceCoder.marked)
    if plan != "columns" or key is None:
        raise ValueError("plan is rows, or columns with a key")
    spark = df.sparkSession
    own_key, rare, held = unused(df, "_key", "_rare", "_held")
    pieces, vocab = X.pieces(df[text]), encoding.lookup(spark)
    others = [c for c in df.columns if c.lower() != out.lower()]
    counted = df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    missing = counted.join(vocab, X.piece_bytes(F.col("piece")) == vocab["bytes"], "left_anti")
    frequent = missing.orderBy(F.desc("n"), "piece").limit(MOST_PIECES + 1).select(X.piece_bytes(F.col("piece")).alias("data"))
    merged = encode_pieces(frequent.repartition(spark.sparkContext.defaultParallelism), encoding, "data", "ids").collect()
    codes = [(b.decode("latin-1"), [i]) for b, i in encoding.encoder.items()] + [(bytes(r.data).decode("latin-1"), r.ids) for r in merged]
    known = spark.createDataFrame(codes, "piece string, ids array<int>")
    buckets = 1 << (len(codes) - 1).bit_length()
    if len(merged) > MOST_PIECES:
        each = df.select(df[key].alias("key"), F.posexplode(pieces).alias("pos", "piece")).join(F.broadcast(known.select("piece")), "piece", "left_anti")
        rest = each.groupBy(X.piece_bytes(F.col("piece")).alias("data")).agg(F.collect_list(F.struct("key", "pos")).alias("at"))
        rest = encode_pieces(rest, encoding, "data", "ids", kept="at").select(F.explode("at").alias("at"), "ids").select("at.key", "at.pos", "ids")
        gathered = rest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias(rare)).withColumnRenamed("key", own_key)
        df = df.join(gathered, df[key].eqNullSafe(gathered[own_key]), "left")
    else:
        df = df.withColumn(rare, F.lit(None).cast("array<struct<pos:int,ids:array<int>>>"))
    # the optimizer puts the subquery where the column is used, so that rows do not carry the table
    df = df.withColumn(held, _bucketed(known, buckets).scalar())

    def found(table: Column, piece: Column, pos: Column) -> Column:
        own = F.get(F.filter(F.get(table, _bucket(piece, buckets)), lambda e: e["piece"] == piece), F.lit(0))["ids"]
        at = F.transform(F.array(below(F.col(rare)["pos"], MOST_VALUES, pos)), lambda i: F.get(F.col(rare), i)["ids"])
        return F.coalesce(own, at[0])

    ids = F.transform(F.array(F.col(held)), lambda table: F.transform(X.pieces(F.col(text)), lambda piece, pos: found(table, piece, pos)))
    return df.select(*others, F.flatten(ids[0]).alias(out))


def _bucket(piece: Column, buckets: int) -> Column:
    return F.hash(piece).bitwiseAND(F.lit(buckets - 1))


def _bucketed(known: DataFrame, buckets: int) -> DataFrame:
    """One value: for each of 2**n hashes of pieces the list of struct(piece, ids), in the order of the hashes."""
    lists = known.groupBy(_bucket(F.col("piece"), buckets).alias("id")).agg(F.collect_list(F.struct("piece", "ids")).alias("own"))
    lists = known.sparkSession.range(buckets).join(lists, "id", "left").select("id", F.coalesce("own", F.array().cast("array<struct<piece:string,ids:array<int>>>")).alias("own"))
    return lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "own"))), lambda b: b["own"]).alias("buckets"))


def encode_pieces(distinct: DataFrame, encoding: Encoding, data: str, out: str, kept: str | None = None) -> DataFrame:
    """Merging for a table of distinct BINARY pieces, without a lookup of the whole piece. ``kept``: a list column that stays."""
    spark = distinct.sparkSession
    vocab = encoding.lookup(spark).select(F.col("bytes").alias("known"), F.col("id"))
    col, size = F.col("data"), F.octet_length("data")
    distinct = distinct.select(F.col(data).alias("data"), (F.col(kept) if kept else F.lit(None).cast("array<int>")).alias("kept"))
    short = F.when((size > 1) & (size <= merge.SHORT), merge.first_byte_merge(col, encoding))
    distinct = distinct.withColumn("long", merge.long_merge(encoding)(F.when(size > merge.SHORT, col)))
    starts = F.when(size > merge.SHORT, F.col("long")).when(size > 1, short).when(size == 1, F.array(F.lit(0)))
    # bound to a variable: the parts look at the starts again and again, which would be merged anew each time
    bound = F.transform(F.array(starts), lambda s: merge.parts(col, s))[0]
    split = distinct.select("data", "kept", F.posexplode(bound).alias("k", "part")).withColumn("kept", F.when(F.col("k") == 0, F.col("kept")))
    coded = split.join(vocab, F.col("part") == F.col("known"), "left")
    ids = F.array(*map(F.lit, encoding.byte_ids))
    code = F.hex("part")
    singles = F.transform(F.sequence(F.lit(0), F.octet_length("part") - 1), lambda i: F.get(ids, F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))
    coded = coded.select("data", "k", "kept", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(singles).alias("ids"))
    gathered = coded.groupBy("data").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("all"), *[F.flatten(F.collect_list("kept")).alias("kept")][: bool(kept)])
    return gathered.select(F.col("data").alias(data), F.flatten(F.transform("all", lambda x: x["ids"])).alias(out), *[F.col("kept").alias(kept)] if kept else [])


def allowed_list(encoding: Encoding, allowed: str | Sequence[str] | None) -> list[str]:
    if not allowed:
        return []
    if isinstance(allowed, str):
        return list(encoding.specials) if allowed == "all" else [allowed]
    return list(allowed)


def special_pieces(text: Column, encoding: Encoding, names: Sequence[str]) -> Column:
    """Pieces between the allowed strings, and marked names of special tokens."""
    quoted = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in names if n)
    parts = F.regexp_extract_all(text, F.lit(f"(?s){quoted}|(?:(?!{quoted}).)+"), F.lit(0))
    known = F.array(*map(F.lit, encoding.specials)) if encoding.specials else F.array().cast("array<string>")
    return F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(known, p), F.array(F.concat(F.lit(SPECIAL), p))).otherwise(X.pieces(p))))


def encode(df: DataFrame, encoding: Encoding, allowed: str | Sequence[str] | None = None, text: str = "text", out: str = "tokens") -> DataFrame:
    """Texts with special tokens: None, "all", one, or a list in order of preference.

    The text is split at the allowed strings; a part equal to any special token
    gets its id, every other part is encoded by itself.
    """
    names = allowed_list(encoding, allowed)
    if not any(names):
        return encode_ordinary(df, encoding, text, out)
    return _gathered(df, out, encoding, special_pieces(df[text], encoding, names), PieceCoder.marked)


def encode_bytes(df: DataFrame, encoding: Encoding, data: str = "data", out: str = "tokens") -> DataFrame:
    """Whole BINARY values, merged without pre-tokenization or lookup of the whole."""
    return _gathered(df, out, encoding, df[data].cast("binary"), PieceCoder.merged)


def encode_single_piece(df: DataFrame, encoding: Encoding, data: str = "data", out: str = "tokens") -> DataFrame:
    """The id of the whole value if it is a token, else its merged parts."""
    return _gathered(df, out, encoding, df[data].cast("binary"), PieceCoder.piece)


def encode_single_token(df: DataFrame, encoding: Encoding, data: str = "data", out: str = "token") -> DataFrame:
    """The id of a token or special token by its bytes; 0 if there is none."""
    spark = df.sparkSession
    names = unused(df, "_plain", "_plain_id", "_special", "_special_id")
    plain = encoding.lookup(spark).toDF(*names[:2])
    special = F.broadcast(encoding.special_table(spark).select(F.encode("token", "UTF-8").alias(names[2]), F.col("id").alias(names[3])))
    value = df[data].cast("binary")
    joined = df.join(plain, value == plain[names[0]], "left").join(special, value == special[names[2]], "left")
    found = F.when(value.isNotNull(), F.coalesce(plain[names[1]], special[names[3]], F.lit(0)))
    return joined.select(*[df[c] for c in df.columns if c.lower() != out.lower()], found.alias(out))


def encode_unstable(df: DataFrame, encoding: Encoding, allowed: str | Sequence[str] | None = None, text: str = "text", out: str = "unstable", observed: bool = False) -> DataFrame:
    """struct(tokens, completions). Completions are always empty; ``observed`` leaves the tokens out too."""
    none = F.array().cast("array<int>")
    completions = X.completions().alias("completions")
    if observed:
        return df.withColumn(out, F.struct(none.alias("tokens"), completions))
    (ids,) = unused(df, "_tokens")
    return encode(df, encoding, allowed, text, ids).withColumn(out, F.struct(F.col(ids).alias("tokens"), completions)).drop(ids)


encode_with_unstable = encode_unstable


def fallback_encode(df: DataFrame, encoding: Encoding, text: str = "text", out: str = "tokens") -> DataFrame:
    """Unicode classes, whole pieces, and single bytes for the others; nothing is merged."""
    return _gathered(df, out, encoding, X.unicode_pieces(df[text]), lambda coder, piece: coder.whole_or_spelled(piece.encode()))


def flat(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """A row for each id: key, pos, token_id."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token_id"))


def token_count(tokens: Column) -> Column:
    return F.size(tokens).cast("bigint")
