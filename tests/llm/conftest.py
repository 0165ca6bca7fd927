import pytest

#: doc_id, text, lang, source, and columns whose names clash with results.
HARD = [
    (1, None, "en", "a", 9, "x", 1.0), (2, "", None, "a", 9, "x", 1.0), (3, " \n\t\x0b ", "de", None, 9, "x", 1.0),
    (None, "The same words again and again here", "en", "a", 9, "x", 1.0),
    (4, "The same words again and again here", "en", "b", 9, "x", 1.0),
    (4, "The same words again and again here", "en", "b", 9, "x", 1.0),
    (5, "Straße Éa 中文 😀 1234", None, None, 9, "x", 1.0), (6, "12 34 !!", "en", "a", 9, "x", 1.0),
    (7, "lorem ipsum dolor sit amet " * 9000, "fr", "a", 9, "x", 1.0), (8, "y" * 150_000, "fr", "a", 9, "x", 1.0),
    (9007199254740993, "one two three four five six seven", "en", "a", 9, "x", 1.0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score int, kept string, length double"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    return spark.createDataFrame(HARD, SCHEMA).coalesce(1)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture
def folder(spark):
    from cuelake.llm.common import scratch

    return scratch(spark)
