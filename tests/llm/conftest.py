import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows with extra columns whose names the operators use inside."""
    def make(rows, lang="en"):
        df = spark.createDataFrame([(i, t, lang, "s", len(t) if t else 0) for i, t in rows], DOCS)
        for extra in ("fp", "text_key", "words", "row", "removed", "h1", "short", "maybe"):
            df = df.selectExpr("*", f"'x' as {extra}")
        return df
    return make
