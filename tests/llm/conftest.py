import pytest

#: Texts of the edge cases: null, empty, blank, ties, repeats, odd code points, and a very long one.
EDGE_TEXTS = [None, "", " \n\t", "one", "two words", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "é ü 日本 🙂", "x" * 5000, "word " * 20000]


@pytest.fixture()
def edge_docs(spark):
    """documents with edge texts, null fields, a null and a repeated doc_id, and extra columns whose names clash."""
    rows = [(k, t, "en" if k % 2 else None, None, None if t is None else len(t), True, "x", 1) for k, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "a b c d e f g h i j k l", None, None, 1, None, None, None), (3, "one", "en", "s", 3, False, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fingerprint string, print long")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
