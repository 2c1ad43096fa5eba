import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of some texts, numbered from 1, or of (id, text) pairs."""
    def make(texts, source="a", lang="en"):
        pairs = [text if isinstance(text, tuple) else (k + 1, text) for k, text in enumerate(texts)]
        return spark.createDataFrame([(k, text, lang, source, len(text or "")) for k, text in pairs], SCHEMA)
    return make


ODD = [None, "", "   \n\t ", "word", "word", "ÀÉ ß\n\nπ", "x" * 100_000, "long text " * 20_000, "a\x00b   c d"]


@pytest.fixture
def odd():
    """Null, empty, blank, repeated, and very long texts."""
    return list(ODD)


@pytest.fixture(scope="session")
def documents_small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
