"""Token ids back to bytes and text, row by row and without a shuffle."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.sources.vocab import Encoding


def _texts(encoding: Encoding) -> tuple[Column, int]:
    """The bytes of each id, a character a byte, as a constant array; and its size."""
    size = max(encoding.decodable, default=-1) + 1
    each = [encoding.decodable.get(i, b"").decode("latin-1") for i in range(size)]
    return F.from_json(F.lit(json.dumps(each)), "array<string>"), size


def _text_of(token: Column, texts: Column, size: int) -> Column:
    i = F.pmod(token.cast("bigint"), F.lit(1 << 32))
    return F.coalesce(F.get(texts, F.when(i < size, i).otherwise(-1).cast("int")), F.lit(""))


def token_bytes(token: Column, encoding: Encoding) -> Column:
    """The bytes of an id; none for an unknown one. Ids wrap to unsigned 32 bits."""
    return F.encode(_text_of(token, *_texts(encoding)), "ISO-8859-1")


def decode_bytes(tokens: Column, encoding: Encoding) -> Column:
    texts, size = _texts(encoding)
    return F.encode(F.array_join(F.transform(tokens, lambda t: _text_of(t, texts, size)), ""), "ISO-8859-1")


def decode(tokens: Column, encoding: Encoding) -> Column:
    """Text of the ids; malformed UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(decode_bytes(tokens, encoding).cast("string"))
