"""Collocations: the summaries' guarantee, brute force on a small table, and odd input."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

import parity
from odd_tables import no_docs, odd_docs, table  # noqa: F401
from panelmill.llm import collocations as C


def brute_force(rows, min_count, percent, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = set()
    for lang, of in counts.items():
        long = {p: a for p, a in of.items() if len(p) > 1 and a >= min_count}
        found, around = [], Counter()
        for q, f in long.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    around[q[i:i + k]] = max(around[q[i:i + k]], f)
        for p, a in long.items():
            if around[p] and 100 * around[p] >= percent * a:
                continue
            score, cut = min((2_000_000 * a // (of[p[:j]] + of[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), of[p[:cut]], of[p[cut:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


def result(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(table, seed):
    rng = random.Random(seed)
    words = ["Ab", "cd", "é", "x1", "日本", "of", "the"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"])
                                                         for _ in range(rng.randint(0, 60)))) for _ in range(120)] + [("en", None), ("fr", "")]
    docs = table([(lang, text, "x") for lang, text in rows], "lang string, text string, phrase string")
    mining = C.Mining(min_count=4, inside_percent=60, top=25, slack=1, filter_bits=1 << 10)
    assert result(C.collocations(docs, mining)) == brute_force(rows, 4, 60, 25)


@pytest.mark.parametrize("slack", [1, 2])
def test_every_frequent_key_survives(slack):
    """Skewed keys in random blocks, merged in any order: cuts stay below the threshold, and memory below the capacity."""
    rng = np.random.default_rng(slack)
    keys = np.minimum(rng.zipf(1.15, 200_000), 10**6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    threshold = 30
    summary = C.Summary(slack * len(keys) // threshold + 1)
    for part in np.array_split(rng.permutation(keys), 37):
        local = C.Summary(summary.capacity)
        local.merge(part, np.ones(len(part), np.int64))
        summary.merge(local.keys, local.counts, local.cut)
        assert len(summary.keys) <= summary.capacity
    true = Counter(keys.tolist())
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert 0 < summary.cut < threshold / slack
    assert all(kept.get(k, 0) <= n <= kept.get(k, 0) + summary.cut for k, n in true.items())
    assert {k for k, n in true.items() if n >= threshold} <= set(kept)


def test_a_full_table_of_bits_loses_nothing(table):
    """With 64 bits for hundreds of phrases nearly all pass, and the counts are the same."""
    docs = table([("en", " ".join(f"w{(i * j) % 50}" for i in range(300))) for j in range(1, 30)], "lang string, text string")
    wide, narrow = (result(C.collocations(docs, C.Mining(min_count=5, filter_bits=bits))) for bits in (1 << 20, 64))
    assert wide == narrow and wide


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert result(C.collocations(odd_docs, C.Mining(min_count=2, top=50))) == brute_force(rows, 2, 80, 50)
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    """2,000,000 * a passes 64 bits for a over 4.6e12."""
    counts = spark.createDataFrame(
        [("en", 1, "a", 9_000_000_000_001), ("en", 1, "b", 8_999_999_999_999), ("en", 2, "a b", 8_999_999_999_998)],
        "lang string, k int, phrase string, f long")
    from pyspark.sql import functions as F
    candidates = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    assert C._scored(candidates, counts).first().score == 2_000_000 * 8_999_999_999_998 // 18_000_000_000_000
