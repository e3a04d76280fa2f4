import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a table like ``documents`` from (doc_id, text) or (doc_id, text, lang) rows, with odd extra columns."""

    def make(rows, extra=True):
        full = [(*r, None, None)[:3] + (None, len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            names = ("node", "bucket", "print", "score", "path", "row", "label", "n", "seed")
            return df.selectExpr("*", *(f"'x' as `{name}`" for name in names))
        return df

    return make
