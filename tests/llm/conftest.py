import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls, blanks, ties, repeated rows, a long text, and columns whose names clash with results.
TEXTS = [
    (0, "Alpha beta gamma delta epsilon zeta eta theta.\nSecond line here\nthird line there\nfourth", "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "fr", "b"),
    (4, "Alpha beta gamma  delta epsilon zeta eta theta.\nSecond line here\nthird line there\nfourth", "en", "a"),
    (5, "été d'hiver près de la forêt " * 40, "fr", "b"),
    (5, "été d'hiver près de la forêt " * 40, "fr", "b"),
    (6, "word " * 30_000, "en", "c"),
    (7, "don't <|endoftext|> stop 12345 ▁▁ x y 日本 🙂", "en", None),
    (8, "one", "en", "a"),
    (9, "\n\n\n", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, l, s, "x", 1) for i, t, l, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, file string, n_tokens int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def some(spark):
    """A hundred documents of the small table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
