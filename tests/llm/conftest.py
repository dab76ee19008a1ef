import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as documents with an extra column whose name operators use inside."""

    def make(rows, source="s"):
        return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) or source is None else source[k], len(t or ""), 7) for k, (i, t) in enumerate(rows)], DOCS)

    return make


@pytest.fixture(scope="session")
def tables(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="session")
def texts(tables):
    return {r.doc_id: r.text for r in tables("documents").collect()}
