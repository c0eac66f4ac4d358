import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table from rows of doc_id, text, lang, source."""

    def make(rows, extra=""):
        schema = "doc_id long, text string, lang string, source string" + extra
        return spark.createDataFrame(rows, schema)

    return make
