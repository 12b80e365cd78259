"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    long = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
    rows = [
        (1, "Hello World", "en", "a", 11),
        (2, "hello world", None, "a", None),
        (3, None, "en", None, 0),
        (4, "", "en", "a", 0),
        (5, long, "en", "a", len(long)),
        (5, long, "en", "a", len(long)),
        (None, "Hello World", "en", "a", 11),
        (None, "no id at all", "en", "a", 12),
        (7, "ÀÉ weird – text   with 𝔘nicode", "fr", "b", 30),
        (8, "àé weird – text   with 𝔘nicode", "fr", "b", 30),
        (9, "HELLO WORLD", "en", "a", 11),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns that are named like ones the operators make."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("row_id", "piece", "shard", "bucket", "fp1", "kept", "pid", "words", "a", "b", "class_id", "line", "score")})
