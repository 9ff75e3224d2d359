import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string"


@pytest.fixture
def docs(spark):
    """Null and repeated ids and texts, empty and long texts, ties, and a column with a clashing name."""
    word = "Thnd erer, the*** of\nand  the thion's É\t"
    rows = [(1, "Hello there world. " * 40), (2, None), (3, ""), (3, ""), (None, "the end"), (5, "a"), (6, word * 3000), (7, word), (8, word), (9, "x" * 5000), (10, "  lead\x1c and <|endoftext|>   trail  "), (11, "de la que et der die und " * 30)]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, "p") for i, t in rows], SCHEMA)
