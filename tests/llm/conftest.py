import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, source])."""

    def make(rows, extra=False):
        table = spark.createDataFrame([(i, t, None, s[0] if s else None, None if t is None else len(t)) for i, t, *s in rows], DOCS)
        if extra:  # names that operators use themselves
            for name in ("score", "size", "key", "bucket", "row", "target", "owner", "n", "a", "places", "component_id", "start", "finish", "next_text"):
                table = table.selectExpr("*", f"'x' AS {name}")
        return table

    return make
