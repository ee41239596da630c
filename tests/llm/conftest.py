import pytest


@pytest.fixture(scope="session")
def public_bpe():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and columns with the tables' other names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, "  \n "), (7, "one"), (8, long), (8, long), (None, base), (None, None), (9, "a b c d"), (10, "A b  c d"), (11, "é" * 5000)]
    return spark.createDataFrame([(i, t, "en", "s", "x", 1.5, "y") for i, t in rows], "doc_id long, text string, lang string, source string, html string, value double, item_id string")
