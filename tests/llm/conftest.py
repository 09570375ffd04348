"""Awkward documents for all operators: nulls, empty and long texts, ties, repeated rows, more columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The same text here, five words and more", "en", "b", 1, 0, "x"),
        (2, "the SAME text here, five words and more", "en", "a", 1, 0, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "", 0, 0, ""),
        (None, "a text without an id but with some words in it", None, "a", 1, 0, "x"),
        (None, None, None, None, None, None, None),
        (5, long, "de", "b", 1, 0, "x"),
        (6, long + " end", "de", "b", 1, 0, "x"),
        (7, "Ünïcödé ñandú 漢字     <|endoftext|> !!!", "fr", None, 1, 0, "x"),
        (8, "   \n\t ", "fr", "a", 1, 0, "x"),
        (9, "12345 67890 !!", "fr", "a", 1, 0, "x"),
        (9, "12345 67890 !!", "fr", "a", 1, 0, "x"),
        (10, "x" * 5000, "en", "a", 1, 0, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").persist()
