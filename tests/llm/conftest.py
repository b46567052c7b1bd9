import pytest

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with further columns that clash by name."""

    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns)

    return make
