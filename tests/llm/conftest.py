import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, ties, repeats, a very long text and columns with clashing names."""
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \n\t ", None),
        (4, "One plain sentence with several words in it, and then some more of them here.", "x"),
        (4, "One plain sentence with several words in it, and then some more of them here.", "x"),
        (5, "One plain sentence with several words in it, and then some more of them here.", "y"),
        (6, LONG, "x"),
        (7, "é中文 \U0001f389", "x"),
        (None, "a text without an id but with words", "x"),
    ]
    clashing = "doc_id long, text string, score string, kept string, leaks string, start string, id string, n string, label string"
    return spark.createDataFrame([(a, b, c, c, c, c, c, c, c) for a, b, c in rows], clashing)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
