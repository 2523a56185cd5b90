"""Near-duplicates where one doc_id has several texts: no text may be lost."""

from __future__ import annotations

import corpus_pipeline
from odd_tables import table  # noqa: F401
from panelmill.llm import minhash_dedup

C = " ".join(f"c{i}" for i in range(60))
A = C.replace("c59", "other")
B = " ".join(f"b{i}" for i in range(40))
ROWS = [(3, C), (5, A), (5, B), (9, B), (9, None), (5, A)]


def test_each_text_is_judged_by_itself(table):
    rows = minhash_dedup._judged(table(ROWS, "doc_id long, text string"), minhash_dedup.NearDup(similarity=85)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [
        (3, 56, 3, True), (5, 36, 5, True), (5, 56, 3, False), (5, 56, 3, False), (9, 0, 9, True), (9, 36, 5, False)]


def test_no_text_is_lost(spark, table):
    docs = table([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(3, C), (5, B), (9, "")])


def test_numbers_of_sequences_that_meet_are_drawn_again(table, monkeypatch):
    """With numbers of two values, seeds are tried until none is shared; that can't be here, and is an error."""
    import pytest
    from pyspark.sql import functions as F
    real = F.xxhash64
    sigs = minhash_dedup.signatures(table([(i, f"text {i} a b c d") for i in range(4)], "doc_id long, text string"), minhash_dedup.NearDup())
    assert minhash_dedup.text_classes(sigs).select("node").distinct().count() == 4
    monkeypatch.setattr(minhash_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    with pytest.raises(RuntimeError, match="same number"):
        minhash_dedup.text_classes(sigs)
