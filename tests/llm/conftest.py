from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to a documents table; extra columns may follow as (name and type, value) pairs."""

    def make(rows, *extra):
        schema = ", ".join([DOCUMENTS, *(kind for kind, _ in extra)])
        full = [(i, t, "en", "s", len(t or ""), *(value for _, value in extra)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


# Null, empty, white space, one word, wide characters, a repeated row, a null id, and a very long text.
EDGE_ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "Äö ß 東京 \U0001f600 x\x00y"),
    (6, "same row twice"),
    (6, "same row twice"),
    (None, "no id here"),
    (7, "long " * 60_000),
]


@pytest.fixture(scope="session")
def edge_rows():
    return list(EDGE_ROWS)
