import pandas as pd
import pytest

ODD = "doc_id long, text string, lang string, source string, score double, kept boolean, id long, a string, b string, word string, key string"
LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one two"),
    (7, LONG),
    (8, "!!! ??? 123"),
    (None, "a row without an id has words too"),
    (9, "naïve café\u3000über \U0001f600  two  blanks \r\n end "),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i and i % 2 else "fr", None, 0.5, True, 7, "x", None, "w", "k") for i, t in ROWS]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
