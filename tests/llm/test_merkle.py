"""Merkle fingerprints: trees against hashlib, where an edit lies, and the next document in order."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from odd_tables import LONG_WORD, no_docs, odd_docs, table  # noqa: F401
from panelmill.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def root(text: str) -> str:
    sections, now = [], []
    for line in text.split("\n"):
        now.append(sha("p:" + line))
        if now[-1] < "2" or line.strip(" \t\r") == "":
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    return sha("r:" + "".join(sha("s:" + "".join(s)) for s in sections))


TEXTS = ["", "one line", "\n", "a\n\nb\r\n", "é\tü 日本\n" * 50, LONG_WORD, "\n".join(f"line {i}" for i in range(3_000))]


def test_roots(table):
    df = table([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.with_tree(df, "text").collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].root == root(text)
        assert got[i].n_paragraphs == text.count("\n") + 1
        assert [s.first for s in got[i].sections] == [1, *(s.last + 1 for s in got[i].sections[:-1])]
    assert got[0].pieces == [] and len(got[5].pieces) == 2  # 64 * 8 letters again and again, and the rest


def test_branches_lead_to_the_edit(table):
    lines = [f"this is line number {i} of the text" for i in range(400)]
    edited = [*lines[:100], "put in", *lines[100:250], "other", *lines[251:]]
    before = table([(1, "\n".join(lines)), (2, "same\n\ntext"), (3, "gone")], "doc_id long, text string")
    after = table([(1, "\n".join(edited)), (2, "same\n\ntext"), (4, "new")], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph) for r in merkle.changed_paragraphs(before, after).collect()}
    assert got == {(1, 101), (1, 252), (4, 1)}
    trees = [merkle.with_tree(df, "text").filter("doc_id = 1").select(F.transform("sections", lambda s: s["hash"]).alias("h")).first().h
             for df in (before, after)]
    assert 0 < len(set(trees[1]) - set(trees[0])) <= 4 and len(trees[0]) > 20


def next_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return {r[0]: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_next_document(table, n):
    rows = [(None if i == 3 else (i * 7919) % 1_000 - 500, f"text {i}") for i in range(n)]
    got = {r.doc_id: r.next.text for r in merkle.with_next(table(rows, "doc_id long, text string"), ["text"]).collect()}
    assert got == next_of(rows)


def test_one_id_on_most_rows_spans_ranges(spark, table):
    """A ring over all rows: every text is the next of exactly one, and no range holds the hot id alone."""
    rows = [(i, f"u{i}") for i in range(0, 100)] + [(50, f"hot {i}") for i in range(2_000)]
    df = merkle.with_next(table(rows, "doc_id long, text string"), ["text"])
    got = df.select("doc_id", "text", "next.text").toDF("doc_id", "text", "after").collect()
    assert sorted(r.after for r in got) == sorted(t for _, t in rows)
    where = {r.text: r.after for r in got}
    seen, at = [], "u0"
    for _ in rows:
        seen.append(at)
        at = where[at]
    assert len(set(seen)) == len(rows) and [t for t in seen if t.startswith("u") and t != "u50"] == [f"u{i}" for i in range(100) if i != 50]
    cut = merkle._range_of(F.col("doc_id"), F.xxhash64("text"), [10, 50, 50, 50, 50, 50, 70])
    sizes = {r[0]: r[1] for r in table(rows, "doc_id long, text string").groupBy(cut).count().collect()}
    assert max(sizes.values()) < 600


def test_fingerprints_of_odd_documents(odd_docs, no_docs):
    rows = {}
    for r in merkle.fingerprints(odd_docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[3][0].fingerprint == rows[4][0].fingerprint == root("") and rows[3][0].near_next == 1.0
    assert rows[10][0].fingerprint == rows[11][0].fingerprint and rows[10][0].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for found in rows.values() for r in found)
    assert rows[7][0].n_chars == 70_000 and rows[4][0].edited_sha256 == sha("")
    assert merkle.fingerprints(no_docs).count() == 0


def test_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(merkle.fingerprints(docs)).split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(_part") == 3  # rows; first rows; numbers alone
