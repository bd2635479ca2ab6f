import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, an empty and a long text, ties, repeated rows, and extra columns with names that operators use."""
    long = " ".join(f"word{i % 997} the of {i}" for i in range(20_000))
    rows = [
        (1, "The cat sat on the mat and slept.\nA second line of some words here.", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, long, "en"),
        (5, "The cat sat on the mat and slept.\nA second line of some words here.", "en"),
        (5, "The cat sat on the mat and slept.\nA second line of some words here.", "en"),
        (None, "Le chat est sur le tapis et il dort.", "fr"),
        (7, "12345 !!! ...", None),
        (8, "  \t\n\n ", "fr"),
        (9, "日本語のテキスト é ß 😀 don't <|endoftext|> x", None),
    ]
    names = ["doc_id", "text", "lang"]
    extra = dict(ids="x", shard=1, slot=2, fp=3, component="c", pseudonyms="p", license="l", accepted="a", removed="r", hash=5)
    table = [Row(**dict(zip(names, row)), **extra) for row in rows]
    schema = "doc_id long, text string, lang string, ids string, shard int, slot int, fp int, component string, pseudonyms string, license string, accepted string, removed string, hash int"
    return spark.createDataFrame(table, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
