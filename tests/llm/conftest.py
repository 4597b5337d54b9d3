import pytest

#: Rows with nulls in every column, empty and long texts, ties, repeated rows.
ODD = [
    (None, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, None, "en", None, None),
    (3, "one two", None, "a", 7),
    (3, "one two", None, "a", 7),
    (4, "one  two ", "en", "b", 9),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "x" * 100_000, "en", "c", 100_000),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "c", 57),
    (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "c", 64),
    (9, "\U0001f600 café 中文 a@b.co 4111 1111 1111 1111", "fr", "d", 35),
    (10, " \t\n", "en", "d", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds, with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.withColumns({"_text": F.lit(1), "id": F.lit("x"), "score": F.lit(0), "_copies": F.lit(5), "size": F.lit(2), "a": F.lit(3)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
