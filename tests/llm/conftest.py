import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, and columns that clash with what operators add."""
    base = [("alpha beta gamma delta epsilon zeta " * 12).strip(), "one two three four five six seven\none two three four five six eight\nshort"]
    rows = [(1, None, "x"), (2, "", "x"), (3, base[0], "x"), (4, base[0], "y"), (4, base[0], "y"), (5, base[1], None), (None, base[1], "z"), (6, "word " * 20_000, "x"), (7, "é" * 50_000, "x")]
    return spark.createDataFrame([(*r, 1, "s", True) for r in rows], "doc_id long, text string, source string, row int, fp string, kept boolean")
