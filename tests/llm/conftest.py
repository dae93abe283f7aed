import datetime as dt

import pytest

DOCS = "doc_id long, text string, lang string, line_key string, row_key string, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, one very long text, and columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "en"), (5, long_text, "en"), (6, "one two three four five six seven", "en"),
        (7, "solo", "en"), (7, "solo", "en"), (8, "a\nb\nc\nd", "en"), (9, "x\na\nb\nc\ny", "en"), (None, "one two three four five six seven", "en"), (10, "Solo", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "k", "r", "z") for i, t, g in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def noon():
    return dt.datetime(2024, 1, 1, 12)
