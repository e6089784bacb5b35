import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Same text here, twice over."), (6, "Same text here, twice over."),
    (7, "long " * 30_000), (8, "ünï çødé — 日本語 😀 " * 12), (9, "x" * 300), (9, "x" * 300), (None, "no id"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with results."""
    rows = [(i, t, "en", "s", 0.5, "clash", True, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, spans string, kept boolean, at long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


#: An id with several texts, copies across ids and without one, rows repeated whole.
REPEATED = [
    (1, "a b c d e f g", "x"), (1, "words of its own and only here", "y"), (2, "a b c d e f g", "z"), (3, "z z q", "u"), (3, "z z q", "u"),
    (None, "a b c d e f g", "n"), (None, None, "k"), (None, None, "k"), (7, "", "e"), (8, " ", "s"),
]


@pytest.fixture(scope="session")
def repeated(spark):
    return spark.createDataFrame(REPEATED, "doc_id long, text string, `a.b` string")
