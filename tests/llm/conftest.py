import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, sig string, n long, block string, digest string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing extra columns."""
    long_text = "lorem ipsum dolor sit amet " * 12_000
    texts = [None, "", "   ", "a", "Hello World", "hello world", "HELLO WORLD É", "hello world É", long_text, long_text.upper(), "x" * 50_000, "one two three four five six", "one two three four five six"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", None, "t", None, 5, "b", "d") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "hello world", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(11)
