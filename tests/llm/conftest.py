from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    if not os.path.exists(SF):
        pytest.skip("driver test data absent")
    return SF


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text), with columns that clash with the operators' own names."""

    def make(rows, more: str = "score double, n long, code string, b int"):
        extra = [None] * len(more.split(","))
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + more)

    return make
