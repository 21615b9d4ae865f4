import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCUMENTS)

    return build


@pytest.fixture
def odd(documents):
    """Null ids and texts, empty and blank texts, repeated rows and a very long text."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    return documents([(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "a text with no id at all"), (None, None), (5, long), (6, "x" * 3000), (7, "é世🎉   z")])
