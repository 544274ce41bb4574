import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table, with columns whose names clash with inner ones."""

    def build(rows):
        full = [(k, t, "en", s, 0, "x", 1.0) for k, t, s in ((*r, "src0")[:3] for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string, score double")

    return build
