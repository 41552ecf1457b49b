import pytest

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash with the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "s", 43, 9, "x"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "s", 43, 9, "x"),
        (2, "the quick brown fox jumps over the lazy dog", None, None, None, None, None),
        (3, "", "en", "s", 0, 1, "y"),
        (4, None, "en", "s", 0, 1, "y"),
        (None, None, None, None, None, None, None),
        (None, "einzeln steht dieser satz hier", "de", "s", 30, 1, "z"),
        (5, LONG, "la", "s", len(LONG), 1, "z"),
        (6, "12345 67 !!! \U0001f600", "en", "s", 14, 1, "z"),
        (7, "one", "en", "s", 3, 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, item_id string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
