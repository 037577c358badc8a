"""Columns over the bytes of a text: cutting, pre-tokenization, normalization."""

from __future__ import annotations

import string
import warnings

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The patterns of pieces. The first alternative wins; each character stands for one byte.
# Underscores match nothing and are dropped. The second is for patterns that don't compile, the third for
# characters instead of bytes, with the classes of digits, white space and word characters spelled out.
PATTERN = r"'s|'t|'re|'ve|'d|'ll|'m|[A-Za-z]+|[0-9]+|\r?\n|[ \t\n\x0B\f\r]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"
FALLBACK_PATTERN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+"
UNICODE_WHITE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
UNICODE_PATTERN = rf"'s|'t|'re|'ve|'d|'ll|'m|[A-Za-z]+|\p{{Nd}}+|\r?\n|[{UNICODE_WHITE}]+|[^\p{{L}}\p{{N}}_{UNICODE_WHITE}]"
WHITE = r"[ \t\n\x0B\f\r]"
MARK = "▁"


def before_nul(text: Column) -> Column:
    """The text up to its first NUL character."""
    return F.substring_index(text, "\0", 1)


def latin(text: Column) -> Column:
    """A string with one character for each byte of the UTF-8 text."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def piece_bytes(piece: Column) -> Column:
    return F.encode(piece, "ISO-8859-1")


def pieces(text: Column, pattern: str = PATTERN) -> Column:
    """Pieces of the text, in its order, as byte-per-character strings."""
    return F.regexp_extract_all(latin(before_nul(text)), F.lit(pattern), F.lit(0))


def unicode_pieces(text: Column) -> Column:
    """Pieces of characters; letters and digits beyond ASCII that no alternative takes are dropped."""
    return F.regexp_extract_all(text, F.lit(UNICODE_PATTERN), F.lit(0))


def usable_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern if it compiles, else a plain one and a warning."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # py4j wraps the Java exception
        reason = str(getattr(e, "java_exception", e)).splitlines()[0]
        warnings.warn(f"the pattern does not compile ({reason}); a plain one is used", stacklevel=2)
        return FALLBACK_PATTERN
    return pattern


def completions(*token_lists: Column) -> Column:
    """A set of completions with these lists of ids, in their order."""
    return add_completions(F.array().cast("array<array<int>>"), *token_lists)


def add_completions(found: Column, *token_lists: Column) -> Column:
    for tokens in token_lists:
        found = F.array_append(found, tokens)
    return found


def normalize_text(text: Column) -> Column:
    """ASCII lower case; runs of white space become one marker, none at the start, one less at the end."""
    t = F.translate(before_nul(text), string.ascii_uppercase, string.ascii_lowercase)
    t = F.regexp_replace(t, f"^{WHITE}+", "")
    t = F.regexp_replace(t, f"{WHITE}+", MARK)
    return F.regexp_replace(t, f"{MARK}\\z", "")


def normalize_bytes(data: Column) -> Column:
    """``normalize_text`` of a BINARY that need not be UTF-8, byte by byte."""
    mark = MARK.encode().decode("latin-1")
    t = F.translate(before_nul(F.decode(data, "ISO-8859-1")), string.ascii_uppercase, string.ascii_lowercase)
    t = F.regexp_replace(F.regexp_replace(t, f"^{WHITE}+", ""), f"{WHITE}+", mark)
    return F.encode(F.regexp_replace(t, f"{mark}\\z", ""), "ISO-8859-1")


def is_space_marker(data: Column, at: Column | int = 0) -> Column:
    """Whether a marker starts at this byte and ends the text: the test reads the terminator too."""
    raw, at = data.cast("binary"), F.lit(at) if isinstance(at, int) else at
    return (F.substring(raw, at + 1, F.lit(3)) == F.lit(MARK.encode())) & (F.octet_length(raw) == at + 3)


def normalize_line(text: Column, size: int) -> Column:
    """``normalize_text`` into a buffer of ``size`` bytes, as BINARY.

    Output stops once ``size - 4`` bytes are written; a marker is written whole.
    """
    room = max(size - 4, 0)
    t = F.translate(before_nul(text), string.ascii_uppercase, string.ascii_lowercase)
    t = F.regexp_replace(F.regexp_replace(t, f"^{WHITE}+", ""), f"{WHITE}+", MARK)
    raw = F.encode(t, "UTF-8")
    code = F.hex(raw)
    mark = MARK.encode().hex().upper()
    # a marker that starts before the edge is kept whole, in up to two bytes past it
    over = F.coalesce(
        *[F.when((F.substring(code, 2 * (room - back) + 1, 6) == mark) if room >= back else F.lit(False), F.lit(room + 3 - back)) for back in (1, 2)],
        F.lit(room),
    )
    cut = F.substring(raw, F.lit(1), F.least(F.octet_length(raw), over))
    tail = F.hex(cut).endswith(mark)
    return F.when(tail, F.substring(cut, F.lit(1), F.octet_length(cut) - 3)).otherwise(cut)


def marker_stats(normalized: Column, observed: bool = False) -> Column:
    """struct(length, markers, characters): bytes, markers, and bytes that are not of a marker.

    ``observed`` counts only a marker that ends the text, as ``is_space_marker`` has it.
    """
    size = F.octet_length(normalized)
    markers = ((size - F.octet_length(F.replace(normalized, F.lit(MARK), F.lit("")))) / 3).cast("int")
    if observed:
        markers = F.when(normalized.isNotNull(), F.coalesce(is_space_marker(normalized, F.greatest(size - 3, F.lit(0))), F.lit(False)).cast("int"))
    return F.struct(size.alias("length"), markers.alias("markers"), (size - 3 * markers).alias("characters"))
