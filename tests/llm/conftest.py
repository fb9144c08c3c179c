"""Small tables with the awkward rows that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kind int, size string"


def rows(texts):
    """Documents with null fields and extra columns whose names operators use inside."""
    out = []
    for i, text in enumerate(texts):
        lang, source = ("en" if i % 3 else None), (f"s{i % 4}" if i % 5 else None)
        out.append((i, text, lang, source, len(text or ""), f"x{i}", i, "big"))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts):
        return spark.createDataFrame(rows(texts), SCHEMA)

    return make
