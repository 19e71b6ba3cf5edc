"""Small-table helpers of the tests in this folder."""

import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) + tuple(r[3:]) for r in rows]
        return spark.createDataFrame(full, SCHEMAS["documents"] + extra)

    return make
