import pytest


@pytest.fixture
def docs(spark):
    """Nulls in any column, empty and long texts, copies, repeated rows, extra columns."""
    long = " ".join(f"word{i} mail{i}@host.example.com" for i in range(3000)) + " " + "x" * 5000
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, None, "en", None, 0), (2, "", None, "a", 0), (3, long, "en", "a", 5), (4, near, "en", "b", 7), (5, near, "en", "b", 7), (5, near, "en", "b", 7),
        (6, near + " seventeen", "en", "c", 9), (7, "call +1 (255) 555-8013 now", "en", "c", 9), (8, " \t\n", "de", "c", 3), (9, "Grüße 日本 😀 'll  x", None, "d", 3), (None, "no id here", "en", "d", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


@pytest.fixture
def empty(docs):
    return docs.limit(0)
