import pytest


@pytest.fixture
def documents(spark):
    """Rows as documents with an extra column whose name the operators use inside."""

    def make(rows):
        full = [(i, t, *(list(r) + ["en", "s0"][len(r) :])[:2], None if t is None else len(t), "x") for i, t, *r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "word " * 30000), (6, "same text here"), (7, "same text here"), (8, "é ß \U0001f600 日本語"), (None, "no id at all"), (9, "\x1c    ")]


@pytest.fixture
def odd(documents):
    """Nulls, empty, blank, one word, very long, repeated, odd characters, null id."""
    return documents(ODD)
