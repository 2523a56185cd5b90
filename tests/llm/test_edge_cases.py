"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from conftest import as_dicts
from odd_tables import no_docs, odd_docs, table  # noqa: F401
from panelmill.llm import (
    arrow_output, bpe, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, merkle, minhash_dedup, pii_crf, secret_scan,
)
from panelmill.llm.queries import tokenizer_file

RANKS, MODEL = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("byte_bpe_50k.json")
PER_ROW = {
    "license": license_scan.scan,
    "language": language_id.identify,
    "pii": pii_crf.find,
    "minhash": minhash_dedup.near_duplicates,
    "arrow": lambda docs: arrow_output.encode_and_check(docs, MODEL),
    "lines": line_dedup.without_repeated_lines,
    "secrets": secret_scan.scan,
    "merkle": merkle.fingerprints,
    "bpe": lambda docs: bpe.round_trip(docs, RANKS),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_comes_back(odd_docs, name):
    given = sorted((r.doc_id is None, r.doc_id or 0) for r in odd_docs.select("doc_id").collect())
    out = PER_ROW[name](odd_docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect()) == given


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables_give_empty_results(no_docs, name):
    assert PER_ROW[name](no_docs).count() == 0


def test_contamination_of_odd_documents(odd_docs, no_docs, table):
    items = table([("i", "THE cat sat on the mat and the dog ran to the old house by the sea", "x"), ("short", "tie tie", "x"),
                   (None, "without a number", "x"), ("i", None, "x"), ("empty", " ", "x"), ("i", "w5 w6 w7", "x")],
                  "item_id string, text string, words string")
    out = {}
    for r in decontaminate.contamination(odd_docs, items).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"]), r.contaminated))
    assert out[1] == [(18, 17, ["i"], True)] * 2 and out[2] == out[1][:1]
    assert out[3] == out[4] == out[5] == [(0, 0, [], False)]
    assert out[10] == [(3, 3, ["short"], True)]
    assert out[8][0][1:] == (3, ["i"], False)
    assert sorted(out[None]) == [(0, 0, [], False), (8, 3, [], True)]
    assert decontaminate.contamination(no_docs, items).count() == 0
    nothing = decontaminate.contamination(odd_docs, items.filter("item_id = 'none'"))
    assert nothing.count() == odd_docs.count() and nothing.filter("n_hit > 0 or contaminated").count() == 0


def test_repeated_lines_of_odd_documents(odd_docs):
    out = line_dedup.without_repeated_lines(odd_docs, min_docs=2)
    rows = {r.doc_id: r for r in out.filter("doc_id is not null").collect()}
    assert out.columns.count("n_lines") == 1
    assert (rows[1].text, rows[1].n_lines, rows[1].n_dropped) == ("", 1, 1)
    assert (rows[3].text, rows[3].n_lines, rows[3].n_dropped) == ("", 1, 0)
    assert (rows[5].n_lines, rows[5].n_dropped, rows[5].text) == (2, 0, " \n\t\x0b ")
    assert rows[10].n_dropped == 1 and rows[8].n_dropped == 0


def test_near_duplicates_of_odd_documents(odd_docs):
    rows = {}
    for r in minhash_dedup.near_duplicates(odd_docs).collect():
        rows.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert rows[1] == [(14, 1, True)] * 2 and rows[2] == [(14, 1, False)]
    assert rows[3] == [(0, 3, True)] and rows[5] == [(0, 5, True)]
    assert rows[10] == [(1, 10, True)] and rows[11] == [(1, 10, False)]
    assert sorted(rows[None]) == [(0, None, True), (4, None, True)]


def test_languages_of_odd_documents(odd_docs):
    rows = {r.doc_id: r for r in language_id.identify(odd_docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 6))
    assert all(0 <= r.score <= 1 for r in rows.values())
    unlabelled = odd_docs.withColumn("lang", odd_docs["source"].substr(5, 1))
    assert {r.lang_pred for r in language_id.identify(unlabelled.filter("lang is null or lang = ''").limit(0)).collect()} == set()


VECTORS = [
    (0, [1.0, 0.0, 0.0, 0.0], "x"), (1, [2.0, 0.0, 0.0, 0.0], "x"), (2, [1.0, 0.0, 0.0, 0.0], "x"), (2, [1.0, 0.0, 0.0, 0.0], "x"),
    (3, [0.0, 0.0, 0.0, 0.0], "x"), (4, None, "x"), (5, [1.0, None, 0.0, 0.0], "x"), (6, [1.0, float("nan"), 0.0, 0.0], "x"),
    (7, [float("inf"), 0.0, 0.0, 0.0], "x"), (8, [], "x"), (9, [1.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (11, [-1.0, 0.0, 0.0, 0.0], "x"),
    (None, [1.0, 0.0, 0.0, 0.0], "x"), (12, [1e30, 1e30, 0.0, 0.0], "x"), (13, [1e-30, 1e-30, 0.0, 0.0], "x"),
]


def test_odd_vectors(table):
    vectors = table(VECTORS, "vec_id long, embedding array<double>, node string")
    rows = {}
    for r in embedding_dedup.near_duplicates(vectors).collect():
        rows.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert rows[0] == [(3, 0, True)] and rows[1] == [(3, 0, False)] and rows[2] == [(3, 0, False)] * 2
    assert all(rows[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 11))
    assert rows[9] == [(1, 9, True)] and rows[10] == [(1, 9, False)]
    assert rows[12] == [(1, 12, True)] and rows[13] == [(1, 12, False)]
    assert rows[None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(vectors.filter("vec_id < 0")).count() == 0
    assert embedding_dedup.near_duplicates(vectors.filter("vec_id in (3, 4)")).count() == 2


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, name, stage):
    sf_dir = "/root/testdata/sf0.001"
    out = as_dicts(stage(spark, odd_docs, sf_dir))
    assert out and (name == "byte_bpe" or list(out[0]) == corpus_pipeline.COLUMNS)
    assert stage(spark, no_docs, sf_dir).count() == 0
