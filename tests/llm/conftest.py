import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(rows, extra=""):
        full = [(r + (None,) * 5)[:4] + (len(r[1] or ""),) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        # Columns that operators use inside must not get in the way.
        for name in ("size", "node", "key", "id", "_row", "digest", "text_sha256", "_gone", "_text", "gone", "_h", "_id", "h"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make
