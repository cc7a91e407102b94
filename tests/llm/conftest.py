"""Tables with nulls, empty and long texts, ties, repeats and further columns."""

from __future__ import annotations

import pytest

from mirrorseq.llm.common import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, bucket string, key string, n_words string, score double"
LONG = " ".join(f"word{i % 977}" for i in range(30000))
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "b", 4), (4, LONG, "en", "a", len(LONG)), (5, "one two three", "en", "b", 13),
    (6, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13), (None, "no id here " * 20, "de", "c", 5), (7, "Ünïcödé ß 漢字 \U0001f600 text " * 30, "fr", "c", 9), (8, "the same " * 60, "en", "é", 1),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, 7, 1, "x", "y", "z", 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return read(spark, sf, "documents")
