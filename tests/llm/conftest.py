import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows, and a column whose name an operator also uses."""
    words = " ".join(f"w{i}" for i in range(300))
    near = words.replace("w150 ", "x ")
    rows = [
        (1, words, "en", "a", 1, "s"), (2, words, "en", "a", 1, "s"), (3, near, "en", "b", 1, "s"), (4, None, None, None, None, None), (5, "", "en", "a", 0, "s"),
        (None, "alone in the world", "en", None, 1, "s"), (7, "one two", "de", "b", 1, "s"), (7, "one two", "de", "b", 1, "s"), (8, "one two", "de", "b", 1, "s"),
        (9, "é " * 40_000, "fr", "c", 1, "s"), (10, " \n\t ", "en", "c", 3, "s"), (11, "y" * 100_000, "en", "c", 1, "s"), (12, "a b c d e\na b c d e\nf g h i j k", "en", "a", 1, "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
