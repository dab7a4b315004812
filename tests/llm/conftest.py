from __future__ import annotations

import pytest
from checks import SF_DIR


# Rows that every operator has to take: nulls, blanks, ties, repeats, odd characters, a long text, clashing names.
LONG = "the cat sat on the mat and went away again " * 4000
AWKWARD = [
    (1, "The cat sat on the mat.", "en", "a", 0),
    (1, "The cat sat on the mat.", "en", "a", 0),
    (2, "the CAT sat on the mat.", None, None, 1),
    (3, None, "en", "b", 2),
    (4, "", "de", "b", 3),
    (5, " \t\n ", None, "a", 4),
    (None, "der Hund läuft über die Straße", "de", None, 5),
    (7, "é你好😀 <|im_end|>\x00 ▁", "fr", "c", 6),
    (8, LONG, "en", "a", 7),
    (8, "another text with the same id", "en", "a", 8),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """``documents`` with awkward rows and columns that clash with names used inside."""
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_entry", "_text_key", "entry", "node", "range", "row", "tie", "label", "_gone_id"):
        docs = docs.selectExpr("*", f"n_chars AS {name}")
    return docs


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
