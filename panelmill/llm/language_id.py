"""Language of a text by rank-order profiles of its letter n-grams.

A profile lists a language's most frequent n-grams of one to three letters (a word's border counts as a
letter) by rank. A text's own list is compared with each profile: every n-gram of the text adds the
difference between its two ranks, or the profile's length if the profile lacks it. The least sum wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scratch import stored

UNDETERMINED = "und"
SEGMENT = 1 << 21


@dataclass(frozen=True)
class Profiles:
    """``grams`` in ascending order; ``ranks[l, g]`` is the rank of a gram in language l, or ``size`` if absent."""

    size: int
    languages: list[str] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Number of the lower-case letter of each code point, counted from 1; 0 for all that are no letters."""
    every = (c if c.isalpha() else "\0" for c in map(chr, range(0x110000)))
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in every], np.int64)
    _, number = np.unique(lower, return_inverse=True)
    return number


def letter_rows(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text its letters' numbers, with a single 0 before, between and after words; empty without letters."""
    for text in texts:
        x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        x = np.concatenate([[0], x, [0]])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        yield x if len(x) > 1 else x[:0]


def gram_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 letters, ascending, and their counts. No n-gram goes across a border."""
    grams, counts = [], []
    for lo in range(0, len(x), SEGMENT):
        a = x[lo:lo + SEGMENT + 2]
        own = min(SEGMENT, len(x) - lo)
        one, two, three = a[:own], a[:-1] << 18 | a[1:], a[:-2] << 36 | a[1:-1] << 18 | a[2:]
        found = np.concatenate([one[one != 0], two[:own] | 1 << 54, three[:own][a[1:-1][:own] != 0] | 2 << 54])
        g, c = np.unique(found, return_counts=True)
        grams.append(g)
        counts.append(c)
    if len(grams) <= 1:
        return (grams[0], counts[0]) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    g, place = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """True for the documents that are never learned from. A null doc_id counts as an empty one (held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, size: int = 300, per_language: int = 3000, max_languages: int = 500) -> Profiles:
    """Profiles from ``labelled`` (doc_id, text, lang).

    About ``per_language`` documents of each language are read, chosen by a hash of doc_id; a language with
    fewer gives all. Rows without text or lang teach nothing. Without any the profiles are empty.
    """
    known = labelled.filter("lang is not null and text is not null")
    share = known.groupBy(F.col("lang").alias("l")).agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    share = stored(share, "languages")  # of known size when the join is planned, which then shuffles no texts
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(share, F.col("lang") == F.col("l")).filter(part < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for lang, x in zip(batch.column("lang").to_pylist(), letter_rows(batch.column("text").to_pylist())):
                rows[lang].append(x)
            for lang, parts in rows.items():
                g, c = gram_counts(np.concatenate(parts))
                keep = g != 1 << 54  # two borders, where texts meet
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(g[keep]), pa.array(c[keep])], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    spread = total.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    best = (
        spread.groupBy("lang", "part").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, size).alias("top"))
        .groupBy("lang").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, size).alias("top"))
        .limit(max_languages + 1).collect())
    if len(best) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    best = sorted((r["lang"], [x["gram"] for x in r["top"]]) for r in best)
    grams = np.unique(np.array([g for _, top in best for g in top], np.int64))
    ranks = np.full((len(best), max(1, len(grams))), size, np.int64)
    for row, (_, top) in zip(ranks, best):
        row[np.searchsorted(grams, top)] = np.arange(len(top))
    return Profiles(size, [lang for lang, _ in best], grams, ranks)


def distances(x: np.ndarray, profiles: Profiles) -> np.ndarray:
    """Out-of-place distance to each language as a share (0 to 1) of the largest possible."""
    g, c = gram_counts(x)
    g = g[np.argsort(-c, kind="stable")[:profiles.size]]
    place = np.minimum(np.searchsorted(profiles.grams, g), len(profiles.grams) - 1)
    theirs = np.where(profiles.grams[place] == g, profiles.ranks[:, place], profiles.size)
    apart = np.where(theirs == profiles.size, profiles.size, np.abs(theirs - np.arange(len(g))))
    return apart.sum(axis=1) / (profiles.size * len(g))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score (1 less the distance) and margin (how much farther the next language is).

    A null or empty text and one without letters is ``und`` with score 0; so is every text when there are
    no profiles. Languages at the same distance go by name. Only the text is looked at, the whole of it.
    """
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), profiles, ["doc_id"])


def annotate(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and margin, which replace columns of these names."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "margin")]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, margins = [], [], []
            for x in letter_rows(batch.column("text").fill_null("").to_pylist()):
                if not len(x) or not profiles.languages:
                    lang, score, margin = UNDETERMINED, 0.0, 0.0
                else:
                    d = distances(x, profiles)
                    least = int(np.argmin(d))
                    lang, score = profiles.languages[least], 1.0 - float(d[least])
                    margin = float(np.partition(d, 1)[1] - d[least]) if len(d) > 1 else score
                langs.append(lang)
                scores.append(score)
                margins.append(margin)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                [*keep, "lang_pred", "score", "margin"])
    schema = T.StructType([f for f in docs.select(*keep).schema]).add("lang_pred", "string").add("score", "double").add("margin", "double")
    return rows.mapInArrow(run, schema)


def learned(docs: DataFrame, size: int = 300, per_language: int = 3000) -> Profiles:
    """Profiles from the documents of ``docs`` that aren't held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), size, per_language)


def identify(docs: DataFrame, size: int = 300, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin for each row of ``docs``."""
    return predict(docs, learned(docs, size, per_language)).withColumn("held_out", held_out(F.col("doc_id")))


def in_known_language(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """Rows of ``docs`` (columns as they are) in a language that was learned: not ``und``, and no farther than allowed."""
    marked = annotate(docs, learned(docs), docs.columns)
    return marked.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select(*docs.columns)
