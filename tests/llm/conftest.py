import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, `group` int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns whose names operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, None, "en", "src1", 0, None, "x", 1),
        (2, "", None, "src2", 0, 1.0, None, None),
        (3, " \n\t ", "en", None, 3, 1.0, "x", 1),
        (4, words, "en", "src1", 1, 1.0, "x", 1),
        (4, words, "en", "src1", 1, 1.0, "x", 1),
        (5, words.upper(), "de", "src3", 1, 0.0, "y", 2),
        (6, (words + " ") * 4000, "fr", "src1", 1, 0.0, "y", 2),
        (7, "x" * 50_000, "fr", "src0", 1, 0.0, "y", 2),
        (8, "été 12 ? a@b.co 1.2.3.4 — +1 (212) 555-0100", "fr", "src0", 1, 0.0, "y", 2),
        (9, "12345 67890 !!!", "es", "src0", 1, 0.0, "y", 2),
        (None, "no id here at all", "es", "src0", 1, 0.0, "y", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.col("n_chars"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
