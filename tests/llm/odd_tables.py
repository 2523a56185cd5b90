"""Fixtures: tables with everything that a table should not have."""

from __future__ import annotations

import pytest

#: Extra columns whose names the operators use for their own.
CLASHING = ("key", "node", "tid", "w", "pos", "words", "n", "item", "text_id", "score", "lang_pred", "n_lines", "ids", "start", "cell", "e")
LONG_WORD = "a" * 70_000
LONG_TEXT = " ".join(f"w{i}" for i in range(30_000)) + "\n" + "\n".join(f"line {i % 700}" for i in range(5_000))
ROWS = [
    (1, "The cat sat on the mat and the dog ran to the old house by the sea again", "en", "s"),
    (1, "The cat sat on the mat and the dog ran to the old house by the sea again", "en", "s"),
    (2, "the CAT sat on the mat and the dog ran to the old house by the sea again", None, None),
    (3, None, "en", "s"), (4, "", "fr", "s"), (5, " \n\t\x0b ", "de", None), (6, "123 +++ 456", "en", "s"),
    (7, LONG_WORD, "en", "s"), (8, LONG_TEXT, "en", "s"), (9, "été où l'élève à côté de la forêt\r\nÉTÉ", "fr", "s"),
    (None, "a text without a number of its own", "en", "s"), (None, None, None, None),
    (10, "tie tie tie", "en", "s"), (11, "tie tie tie", "en", "s"), (12, "日本語 😀 text x \x85 y", "xx", "s"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns of any name."""
    rows = [(*r, None if r[1] is None else len(r[1]), *(["x"] * len(CLASHING))) for r in ROWS]
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.filter("doc_id < 0")


@pytest.fixture
def table(spark):
    """A table of the given columns from rows, dealt over a few partitions."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
