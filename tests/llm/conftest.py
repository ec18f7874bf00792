import pytest

LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(20_000))
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog again and again, you see"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "The quick brown fox jumps over the lazy dog again and again, you see"),
    (4, "The quick brown fox jumps over the lazy dog again and again, you see"),
    (None, "a text without an id stands here"),
    (5, "éÉß ÀÇ ñandú ½ Größe ΣΑΣ"),
    (6, LONG),
    (7, "one"),
    (8, "one two"),
    (9, "\x00nul inside\x00 and\x00"),
    (10, "  odd spaces  x \ny  z\r\n"),
    (11, "日本語の文 😀😀"),
    (12, "12345 678 ... !!!"),
    (13, "a" * 3000),
]
#: Names that operators use for columns of their own.
EXTRA = "lang string, score double, start long, node long, component string, shard string, kind int, ids string, __id int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, odd and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en" if i and i % 2 else None, None, 5, None, "c", None, None, "x", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS
