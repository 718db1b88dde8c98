import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, __size long, h string, node long, k long, slice int, id int, positions string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source), with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = [(d, t, "en", s, None, "e", 1, "h", 2, 3, 4, 5, "p") for d, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n \n", None), (None, "no id here, five words and more", "b"), (4, "same text in two rows of five", "b"), (4, "same text in two rows of five", "b"),
    (5, "same text in two rows of five", None), (6, "x", "c"), (7, "word " * 60000, "c"), (8, "é日本🎉\x00\u3000!!", "c"), (9, "!!! ???", "c"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD).repartition(3)


@pytest.fixture(scope="session")
def none(make):
    return make(ODD).limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("extra", F.lit(1))
