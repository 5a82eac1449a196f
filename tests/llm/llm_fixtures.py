"""Fixtures of the training-data operator tests."""

import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples, with an extra column."""

    def make(*rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or ""), "more") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string")

    return make
