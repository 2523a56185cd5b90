"""Phrases that occur together more than their parts would, per language.

Frequent phrases are found length by length: a phrase can only be frequent if the two phrases of one word less in it are.
For each length, tasks count the phrases that are left by hash and send the counts to hash partitions; a partition merges
them in a Misra-Gries summary whose capacity is several times the mass of the partition divided by the threshold.
Cutting a summary back to its capacity takes the same amount from more counters than it holds, so all cuts together
take less than the threshold, and every frequent phrase survives. The survivors, as bits of a table of fixed size, say
what the second pass over the texts counts exactly, by the phrase itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.kernels import LOWER, mix, pieces, span_hashes, utf8, word_spans
from panelmill.llm.scratch import stored

CHUNK_BYTES = 1 << 20
HELD = 1 << 20
ROW_COUNTERS = 1 << 13
BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
_IS_WORD = ~_IS_BREAK & ~np.isin(np.arange(256), list(b" \t"))
_SECOND = np.random.default_rng(1).permutation(256).astype(np.uint8)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
SUMMARY = "bucket int, kind int, mass long, keys binary, counts binary"


@dataclass(frozen=True)
class Mining:
    """``slack`` times mass / ``min_count`` is a summary's capacity; ``filter_bits``, a power of two, is the size of
    a table of survivors: too small a table lets more phrases through to the exact count, and loses none."""

    min_count: int = 30
    max_words: int = 4
    inside_percent: int = 80
    top: int = 2000
    slack: int = 4
    filter_bits: int = 1 << 26


class Words:
    """The words of some texts: 64-bit hash (with the language), and whether the next word is in the same piece.

    A-Z is lower-cased, pieces end at ``BREAKS`` and at the end of a text, blank and tab separate words.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, seeds: np.ndarray):
        self.low = LOWER[raw]
        self.is_word = _IS_WORD[self.low]
        self.start, self.end, first = word_spans(self.is_word, at)
        self.n = len(self.start)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.seed = seeds[self.text]
        breaks = np.cumsum(_IS_BREAK[self.low], dtype=np.int32)
        piece = breaks[self.start]
        self.goes_on = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.hash = mix(span_hashes(self.low, self.start, self.end) + self.seed)

    def second_hash(self) -> np.ndarray:
        return mix(span_hashes(_SECOND[self.low], self.start, self.end) ^ self.seed)

    def phrases(self, longest: int, filters: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For 1 to ``longest`` words: hashes of the phrases from each word on, and which of them are left.

        A phrase is left if it lies in one piece and its parts pass the filters of their lengths.
        """
        key, left = self.hash, np.ones(self.n, bool)
        for k in range(1, longest + 1):
            if k > 1:
                key = extended(key, self.hash, k)
                left = left[:-1] & left[1:] if len(left) else left
                if k == 2:
                    left = left & self.goes_on
            yield key, left
            if k <= len(filters):
                left = left.copy()
                left[left] = passes(filters[k - 1], key[left])

    def texts(self, of: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words from the words ``of`` on, joined by blanks."""
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(self.low[self.is_word])])
        if k == 1:
            return words.take(pa.array(of))
        return pc.binary_join_element_wise(*(words.take(pa.array(of + j)) for j in range(k)), pa.scalar(" ", pa.large_string()))


def extended(key: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of ``k`` words from those of one word less."""
    return mix(key[:-1] * _STEP + word[k - 1:]) if len(key) else key


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    mask = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(keys), bool)
    for place in (keys & mask, keys >> np.uint64(32) & mask):
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class Summary:
    """Misra-Gries summary of weighted keys. Counts are at most ``cut`` too small, and never too large.

    ``cut * (capacity + 1)`` is at most the mass that was put in.
    """

    def __init__(self, capacity: int):
        self.capacity, self.cut = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, cut: int = 0) -> None:
        """Adds counters, of one key once or often, from which ``cut`` was taken before."""
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.cut += cut
        if len(self.keys) > self.capacity:
            most = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > most
            self.keys, self.counts = self.keys[stay], self.counts[stay] - most
            self.cut += most


def phrase_counts(docs: DataFrame, mining: Mining) -> DataFrame:
    """lang, k, phrase, f: how often each phrase of up to ``max_words`` words occurs, if ``min_count`` times or more.

    A row with k = 0 and an empty phrase holds the number of all words of the language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    filters: list[Broadcast] = []
    for k in range(1, mining.max_words + 1):
        filters.append(spark.sparkContext.broadcast(_bits(_survivors(rows, k, list(filters), mining), mining.filter_bits)))
    exact = (
        rows.mapInArrow(_exact(filters), "lang string, k int, phrase string, f long")
        .groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= mining.min_count) | (F.col("k") == 0)))
    counts = stored(exact, "phrases")
    for f in filters:
        f.unpersist()
    return counts


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, a and phrase.

    A candidate is a phrase of two words or more that occurs a >= ``min_count`` times. Cut after its first words, its first
    part occurs l and the rest r times; its score is the least floor(2,000,000 * a / (l + r)) over all cuts. A candidate
    inside a longer one with ``inside_percent`` of its count or more goes. Null lang is ``und``, a null or empty text has
    no words, repeated rows count as often as they come; no documents, no rows. Only the columns lang and text are read.
    """
    counts = phrase_counts(docs, mining)
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    best = _scored(candidates, counts).join(_largest_around(candidates), ["lang", "phrase"], "left")
    big = "decimal(38,0)"
    kept = best.filter(F.col("around").isNull() | (
        F.col("around").cast(big) * 100 < F.col("a").cast(big) * mining.inside_percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "_part"], ["lang"]):  # at most 64 * top rows of a language meet
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= mining.top)
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the cut that scores least, the first of several."""
    part = counts.filter("k > 0").select("lang", "phrase", "f")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return (
        cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
        .select("lang", "phrase", "a", "least.l", "least.r", "least.score"))


def _largest_around(candidates: DataFrame) -> DataFrame:
    """lang, phrase, around: the largest count of a longer candidate that holds the phrase."""
    inner = candidates.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    return inner.groupBy("lang", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase")).agg(F.max("a").alias("around"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of some megabytes of texts at a time, and the language of each text; a longer text is alone."""
    seeds: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs) - seeds.keys():
            seeds[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")
        seed = np.array([seeds[x] for x in langs], np.uint64)
        raw, at = utf8(batch.column("text"))
        for a, b in pieces(at, CHUNK_BYTES):
            words = Words(raw[at[a]:at[b]], at[a:b + 1] - at[a], seed[a:b])
            if words.n:
                yield words, langs[a:b]


def _survivors(rows: DataFrame, k: int, filters: list[Broadcast], mining: Mining) -> DataFrame:
    """Hashes (column key) of phrases of ``k`` words, with every one that occurs ``min_count`` times or more."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for words, _ in _chunks(batches):
            for key, left in words.phrases(k, tables):
                pass
            found = key[left]
            held.append(summed(found, np.ones(len(found), np.int64)))
            if sum(len(keys) for keys, _ in held) > HELD:
                held = [_all(held)]
                if len(held[0][0]) > HELD // 2:
                    yield _counters(*held[0], buckets)
                    held = []
        if held:
            yield _counters(*_all(held), buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(batches, mining)

    return (
        rows.mapInArrow(count, SUMMARY).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
        .mapInArrow(merge, "key long"))


def _all(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _counters(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """For each bucket a row of kind 0 with the mass, and rows of kind 1 with some thousand counters each."""
    bucket = (keys >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    rows = []
    for b, a, e in zip(*_runs(bucket)):
        rows.append((int(b), 0, int(counts[a:e].sum()), None, None))
        rows += [(int(b), 1, None, keys[i:min(i + ROW_COUNTERS, e)].tobytes(), counts[i:min(i + ROW_COUNTERS, e)].tobytes())
                 for i in range(a, e, ROW_COUNTERS)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["bucket", "kind", "mass", "keys", "counts"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each run of equal values."""
    if not len(values):
        return values, values, values
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[start], start, np.r_[start[1:], len(values)]


def _merged(batches: Iterator[pa.RecordBatch], mining: Mining) -> Iterator[pa.RecordBatch]:
    """A summary for one bucket after the other. Its masses come first, so that its capacity is known before any counter."""
    now, mass, summary, waiting, size = None, 0, None, [], 0

    def close() -> pa.RecordBatch:
        if waiting:
            summary.merge(*_all(waiting))
        likely = summary.keys[summary.counts + summary.cut >= mining.min_count] if summary else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(likely.view(np.int64))], ["key"])

    for batch in batches:
        for bucket, kind, part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if bucket != now:
                if now is not None:
                    yield close()
                now, mass, summary, waiting, size = bucket, 0, None, [], 0
            if kind == 0:
                mass += part
                continue
            if summary is None:
                summary = Summary(mining.slack * mass // mining.min_count + 1)
            waiting.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
            size += len(waiting[-1][0])
            if size > max(summary.capacity, HELD // 2):
                summary.merge(*_all(waiting))
                waiting, size = [], 0
    if now is not None:
        yield close()


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    """Table of ``size`` bits with two bits set for each key; the driver gets its words that are not zero, size / 64 at most."""
    place = F.explode(F.array(F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1)))).alias("place")
    words = (
        keys.select(place).groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow())
    table = np.zeros(size // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _exact(filters: list[Broadcast]):
    """Counts of the phrases that pass the filters, by their text; and of all words, as k = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        for words, langs in _chunks(batches):
            names = pa.array(langs, pa.string())
            size = np.bincount(words.text, minlength=len(langs))
            yield _rows(names, 0, pa.array([""] * len(langs), pa.string()), size)
            word2 = words.second_hash()
            key2 = word2
            for k, (key, left) in enumerate(words.phrases(len(tables), tables[:-1]), 1):
                if k > 1:
                    key2 = extended(key2, word2, k)
                at = np.flatnonzero(left)
                at = at[passes(tables[k - 1], key[at])]
                if len(at):
                    first, counts = _distinct(key[at], key2[at])
                    at = at[first]
                    yield _rows(names.take(pa.array(words.text[at])), k, words.texts(at, k).cast(pa.string()), counts)
    return run


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each pair of hashes, and how often it comes."""
    order = np.lexsort((two, one)) if len(one) else np.zeros(0, np.int64)
    one, two = one[order], two[order]
    start = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    return order[start], np.diff(np.r_[start, len(one)])


def _rows(langs: pa.Array, k: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs, pa.array(np.full(len(counts), k, np.int32)), phrases, pa.array(counts.astype(np.int64))], ["lang", "k", "phrase", "f"])
