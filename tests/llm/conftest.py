import pytest

LONG = "edon ating " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and names that operators use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", 0.5, "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", 0.5, "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", None, None, None),
        (3, None, "en", 0.1, "b"),
        (4, "", "en", 0.1, "b"),
        (5, " \n\t ", "en", 0.1, "b"),
        (6, LONG, "en", 0.1, "b"),
        (None, "nobody knows this text has no number at all", "de", None, "c"),
        (None, None, None, None, None),
        (7, "ünï ￿ 𝔘𝔫𝔦 \u0000 end", "fr", 0.2, "d"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, _key string, _score double, spans string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, _key string, _score double, spans string")
