import pytest

from tokenloom.llm import bpe

SCHEMA = "doc_id long, text string, source string, kept string"
#: Nulls, empty and odd texts, ties, repeated rows, a long text, and a column with a name that operators use.
ROWS = [
    (1, "a b c d"), (2, None), (3, ""), (4, "a b c d"), (4, "a b c d"), (5, " \t\n"), (6, "word " * 3000), (None, "a b c d"), (None, None), (7, "Don't WE'LL <|endoftext|> È́ 日本 x\x1cy"),
    (8, "one"), (9, "The quick brown fox jumps over the lazy dog, and then it rests.\n" * 3), (10, "Ünïcode ßtraße ＡＢＣ 123 ½ 🙂🙂"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None if n % 3 else "s", "x") for n, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def library():
    return bpe.load(open(bpe.default_path(), encoding="utf-8").read())


@pytest.fixture(scope="session")
def long_text():
    """Ten million characters: more than any slice of a batch, in one row."""
    words = [f"{a}{b}" for a in ("stone", "river", "Cloud", "né", "x1") for b in ("", "s", ",", ".", "!")]
    return " ".join(words[(i * i + i // 7) % 25] for i in range(1_650_000))
