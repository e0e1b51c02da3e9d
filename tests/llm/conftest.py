import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id long, score double, word string"


@pytest.fixture
def frame(spark):
    """Documents (doc_id, text, source) with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 0.5, "x") for i, t, s in rows], DOCS).repartition(3)

    return make


#: Nulls in any column, empty and blank texts, ties, repeated rows, very long texts, characters of several bytes.
EDGES = [
    (1, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha beta gamma delta epsilon zeta", "a"), (3, "", "b"), (4, None, None), (5, " \t\n", "b"), (None, "alpha beta", "a"),
    (None, None, None), (6, "ALPHA Beta gamma delta epsilon zeta", "c"), (7, "é ß 漢字 ▁ \u2028 😀", "c"), (8, "word " * 20000, "d"), (9, "x" * 50000, "d"), (10, "one", None), (11, "one", None),
    (12, " ".join(f"d{i}" for i in range(20000)), "e"), (13, "1234567890123456 " * 3000, "e"), (14, "".join(chr(0x4E00 + i * 7 % 20000) for i in range(8000)), "e"), (15, "a" * 300 + "é" * 20000, None),
]


@pytest.fixture
def edges(frame):
    return frame(EDGES)


@pytest.fixture
def nothing(frame):
    return frame([])
