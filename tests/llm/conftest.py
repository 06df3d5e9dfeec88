import pytest

DOCS = "doc_id long, text string, lang string, start long, digest string"  # the last two clash with names of results


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents out of texts, or of (doc_id, text) pairs, over several partitions."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(*r, "en", 7, "x") for r in rows], DOCS).repartition(3)

    return make
