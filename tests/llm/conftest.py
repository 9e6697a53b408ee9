import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents out of (doc_id, text) pairs, with an extra column whose name an operator also makes."""

    def make(rows, extra=False):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' AS kept", "'y' AS piece", "1 AS n_lines", "2 AS fp", "3 AS score") if extra else df

    return make
