"""Rank vocabularies: one JSON object of token -> rank, read on the driver.

Loading rules: quote characters at either end of a token are stripped; of two
tokens with one rank the later wins; tokens ``<...>`` that don't start ``<0x``
are special; ``<0xHH>`` is a single byte; of two ranks with the same bytes the
higher is the encoder's, and the other cannot be decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Single-byte ids, pair ranks and the like fit three bytes.
ABSENT = 0xFFFFFF
#: Tokens up to which a vocabulary's table (about 50 bytes a token) is broadcast.
MOST_TOKENS = 1_000_000


@dataclass(frozen=True)
class Encoding:
    """An immutable vocabulary; small by its file, so its tables may be broadcast."""

    tokens: tuple[str, ...]
    specials: dict[str, int] = field(hash=False)

    @cached_property
    def kinds(self) -> list[str]:
        def kind(t: str) -> str:
            if not t:
                return "dropped"
            if re.fullmatch(r"<0x..>", t, re.DOTALL):
                return "byte" if re.fullmatch(r"<0x[0-9a-fA-F]{2}>", t) else "dropped"
            if t.startswith("<") and t.endswith(">"):
                return "special" if t in self.specials else "dropped"
            return "literal"

        return [kind(t) for t in self.tokens]

    @cached_property
    def decoder(self) -> dict[int, bytes]:
        """All ids with bytes, those that lost theirs to a higher rank too."""
        make = {"byte": lambda t: bytes([int(t[3:5], 16)]), "literal": lambda t: t.encode("utf-8", "surrogatepass")}
        return {i: make[k](t) for i, (t, k) in enumerate(zip(self.tokens, self.kinds)) if k in make}

    @cached_property
    def encoder(self) -> dict[bytes, int]:
        return {b: i for i, b in self.decoder.items()}

    @cached_property
    def decodable(self) -> dict[int, bytes]:
        """What decoding knows: the encoder turned round, then special tokens."""
        return {i: t.encode() for t, i in self.specials.items()} | {i: b for b, i in self.encoder.items()}

    @property
    def vocab_size(self) -> int:
        return len(self.encoder) + len(self.specials)

    @cached_property
    def byte_ids(self) -> list[int]:
        """The id of each single byte, 0 where there is none."""
        return [self.encoder.get(bytes([b]), 0) for b in range(256)]

    @cached_property
    def pair_table(self) -> bytes:
        """Three bytes for each pair of bytes: the rank of that two-byte token, or ABSENT."""
        table = bytearray(b"\xff" * (3 * 65536))
        for b, i in self.encoder.items():
            if len(b) == 2:
                at = 3 * (b[0] * 256 + b[1])
                table[at : at + 3] = i.to_bytes(3, "big")
        return bytes(table)

    def table(self, spark: SparkSession) -> DataFrame:
        """id, token, bytes, kind of every rank."""
        rows = [(i, t, self.decoder.get(i), k) for i, (t, k) in enumerate(zip(self.tokens, self.kinds))]
        return spark.createDataFrame([(i, t, None if b is None else bytearray(b), k) for i, t, b, k in rows], "id int, token string, bytes binary, kind string")

    def encoder_table(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).filter("bytes IS NOT NULL").groupBy("bytes").agg(F.max("id").alias("id"))

    def lookup(self, spark: SparkSession) -> DataFrame:
        """bytes, id; broadcast unless there are very many tokens."""
        found = spark.createDataFrame([(bytearray(b), i) for b, i in self.encoder.items()], "bytes binary, id int")
        return F.broadcast(found) if len(self.encoder) <= MOST_TOKENS else found

    def byte_values(self, spark: SparkSession) -> DataFrame:
        """The bytes of every token of the encoder and every special token."""
        return self.encoder_table(spark).select("bytes").unionByName(self.special_table(spark).select(F.encode("token", "UTF-8").alias("bytes")))

    def special_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.specials.items()), "token string, id int")


def parse(content: str) -> Encoding:
    try:
        ranks = json.loads(content)
        tokens = [""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            if rank >= 0:
                tokens[rank] = token.strip("\"'")
        names = {t.strip("\"'"): r for t, r in ranks.items()}
        specials = {t: r for t, r in names.items() if t.startswith("<") and t.endswith(">") and not t.startswith("<0x")}
    except Exception as e:
        raise ValueError(f"not a rank vocabulary: {e}") from e
    made = Encoding(tuple(tokens), specials)
    if not made.encoder:
        raise RuntimeError("the vocabulary has no token with bytes")
    return made


def load_encoding(path: str) -> Encoding:
    """Read a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def fetch_encoding(urls: str | Sequence[str], timeout: float = 60) -> Encoding:
    """The same from the first of the caller's addresses that has a vocabulary."""
    from urllib.request import urlopen

    failed: Exception | None = None
    for url in [urls] if isinstance(urls, str) else urls:
        try:
            with urlopen(url, timeout=timeout) as answer:
                return parse(answer.read().decode("utf-8"))
        except Exception as e:
            failed = e
    raise ValueError(f"no address has a vocabulary: {failed}") from failed
