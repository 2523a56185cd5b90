"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, and full-set checks.

1. One pass over the texts gives each document its set size, a 128-bit hash of its word sequence and a
   signature of ``chunks * chunk_symbols`` MinHash symbols of 16 bits. Documents with the same words form
   a class; only one of them goes on.
2. Signatures are split into chunks. Two signatures at distance ``chunks * (errors + 1) - 1`` or less agree,
   up to ``errors`` symbols, in some chunk (pigeonhole). Each chunk is indexed once for every way of
   leaving out ``errors`` symbols, so such a pair always meets in a bucket. Buckets keep pairs within that
   distance, as a spanning forest, which makes families.
3. In each family, documents are compared on their full shingle sets, and true links make the components.

Buckets and families of any size are dealt to tasks in blocks (``groups.in_blocks``), and no step emits pairs.
The number of chunks and errors follows from the similarity, so that a pair at the threshold is missed with
probability below 1e-4 (at 85 %: more than 19 of 50 symbols differ, 1.6e-5; at 80 %: more than 27 of 70, 9.9e-05), a closer
one with less; in a group of copies, other links usually connect such a pair as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.components import components
from panelmill.llm.groups import in_blocks, map_groups, spanning_forest
from panelmill.llm.kernels import LOWER, mix, pieces, span_hashes, utf8, word_spans
from panelmill.llm.native_text import text_id
from panelmill.llm.scratch import stored

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def missed(similarity: int, symbols: int, distance: int) -> float:
    """Probability that more than ``distance`` symbols of a pair of this similarity (percent) differ."""
    p = 1 - similarity / 100
    return sum(comb(symbols, k) * p**k * (1 - p)**(symbols - k) for k in range(distance + 1, symbols + 1))


@dataclass(frozen=True)
class NearDup:
    """``similarity`` in percent; ``chunks`` and ``errors`` that are not given are the fewest errors, then the fewest chunks of
    ten to forty, that miss a pair at the threshold with probability below ``miss``. A bucket task holds about ``2 * block_rows`` signatures and a family task
    about ``2 * block_shingles`` shingles (or two documents, if these are longer)."""

    shingle: int = 5
    similarity: int = 80
    chunks: int | None = None
    chunk_symbols: int = 5
    errors: int | None = None
    miss: float = 1e-4
    seed: int = 7
    block_rows: int = 20_000
    block_shingles: int = 2_000_000
    piece_bytes: int = 1 << 20

    def __post_init__(self):
        if self.chunks is None or self.errors is None:
            fit = [(e, c) for e in (range(1, self.chunk_symbols) if self.errors is None else (self.errors,))
                   for c in (range(10, 41) if self.chunks is None else (self.chunks,))
                   if missed(self.similarity, c * self.chunk_symbols, c * (e + 1) - 1) < self.miss]
            if not fit:
                raise ValueError(f"no signature finds pairs of similarity {self.similarity} with a miss below {self.miss}")
            errors, chunks = fit[0]
            object.__setattr__(self, "chunks", chunks)
            object.__setattr__(self, "errors", errors)

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk_symbols

    @property
    def max_distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    def masks(self) -> list[tuple[int, ...]]:
        """Places of a chunk that stay when ``errors`` of them are left out."""
        return list(combinations(range(self.chunk_symbols), self.chunk_symbols - self.errors))

    def hash_rows(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 1 << 63, (2, self.symbols), dtype=np.int64).astype(np.uint64)
        return a * np.uint64(2) + np.uint64(1), b


def shingle_sets(texts: pa.Array, cfg: NearDup) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """(distinct shingle hashes, hash of the word sequence) of each text in turn."""
    raw, at = utf8(texts)
    factors = mix(np.arange(1, cfg.shingle + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for first, last in pieces(at, cfg.piece_bytes):
        part, off = LOWER[raw[at[first]:at[last]]], at[first:last + 1] - at[first]
        start, end, word_at = word_spans(IS_WORD[part], off)
        words = span_hashes(part, start, end)
        n = max(0, len(words) - cfg.shingle + 1)
        windows = np.zeros(n, np.uint64)
        for j in range(cfg.shingle):
            windows += words[j:j + n] * factors[j]
        windows = mix(windows)
        for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist()):
            own = words[a:b]
            whole = _sequence_hash(own)
            if b - a >= cfg.shingle:
                yield np.unique(windows[a:b - cfg.shingle + 1]), whole
            else:
                yield np.array([whole[0]] if b > a else [], np.int64).view(np.uint64), whole


def _sequence_hash(words: np.ndarray) -> tuple[int, int]:
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    both = [mix(words * (mix(place * np.uint64(c)) | np.uint64(1))).sum(dtype=np.uint64) for c in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    return tuple(int(x) for x in mix(np.array(both, np.uint64) + np.uint64(len(words))).view(np.int64))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the least hash under each of the hash functions."""
    least = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(shingles), 2048):
        part = shingles[i:i + 2048, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, cfg: NearDup) -> DataFrame:
    """doc_id, tid (hash of the text), n_shingles, h1, h2 (hash of the word sequence), sig (binary; empty without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = cfg.hash_rows()
        for batch in batches:
            sizes, ones, twos, sigs = [], [], [], []
            for shingles, (one, two) in shingle_sets(batch.column("text"), cfg):
                sizes.append(len(shingles))
                ones.append(one)
                twos.append(two)
                sigs.append(signature(shingles, a, b).tobytes() if len(shingles) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()),
                 pa.array(twos, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "tid", "n_shingles", "h1", "h2", "sig"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("tid"), "text").mapInArrow(
        run, "doc_id long, tid long, n_shingles long, h1 long, h2 long, sig binary")


def text_classes(sigs: DataFrame) -> DataFrame:
    """One row per word sequence: node, doc_id (the smallest), tid (of one of that id's texts), n_shingles, sig, h1, h2.

    ``node`` is a number of 64 bits of the sequence alone, so rows that share a doc_id and not their words are never taken
    for one. The numbers are looked over, and drawn again in the unlikely case that two sequences get the same.
    """
    classes = stored(
        sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "tid")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("h1", "h2", "first.doc_id", "first.tid", "n_shingles", "sig"), "classes")
    for seed in range(8):
        node = F.xxhash64(F.lit(seed), "h1", "h2")
        if classes.groupBy(node.alias("node")).count().filter("count > 1").isEmpty():
            return classes.withColumn("node", node)
    raise RuntimeError("word sequences got the same number again and again")


def chunk_keys(heads: DataFrame, cfg: NearDup) -> DataFrame:
    """(key, node): a row for each chunk and each way of leaving out the allowed errors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = []
            for c in range(cfg.chunks):
                chunk = sig[:, c * cfg.chunk_symbols:(c + 1) * cfg.chunk_symbols].astype(np.uint64)
                for m, kept in enumerate(cfg.masks()):
                    h = np.full(len(chunk), c * 1009 + m + 1, np.uint64)
                    for place in kept:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chunk[:, place])
                    keys.append(h.view(np.int64))
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.tile(node, len(keys)))], ["key", "node"])
    return heads.select("node", "sig").mapInArrow(run, "key long, node long")


def family_edges(heads: DataFrame, cfg: NearDup) -> DataFrame:
    """Edges (a, b) that connect all signatures within the distance limit."""
    keys = chunk_keys(heads, cfg)
    shared = in_blocks(keys, "key", "node", F.lit(1), cfg.block_rows)
    rows = shared.join(heads.select("node", "sig"), "node")

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
        size = np.diff(np.append(starts, len(node)))
        head = np.repeat(starts, size)
        close = (sig != sig[head]).sum(axis=1) <= cfg.max_distance
        far = np.add.reduceat(~close, starts) > 0
        own = close & (np.arange(len(node)) != head)
        own &= ~np.repeat(far, size)
        a, b = [node[own]], [node[head[own]]]
        for g in np.flatnonzero(far).tolist():
            lo, n = int(starts[g]), int(size[g])
            part, ids = sig[lo:lo + n], node[lo:lo + n]
            links = spanning_forest(n, lambda i, j, p=part: (p[j] != p[i]).sum(axis=1) <= cfg.max_distance)
            if links:
                i, j = np.array(links).T
                a.append(ids[i])
                b.append(ids[j])
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])

    return map_groups(rows.select("key", "block_a", "block_b", "node", "sig"), ["key", "block_a", "block_b"], run,
                      "a long, b long").distinct()


def set_links(members: DataFrame, texts: DataFrame, cfg: NearDup) -> DataFrame:
    """Edges (a, b) that connect all members of a family whose full sets are similar enough.

    ``members`` has family, node, n_shingles, and doc_id and tid of one of its texts, ``texts`` doc_id, tid and text;
    the sets are made in the task.
    """
    blocks = in_blocks(members, "family", "node", F.col("n_shingles"), cfg.block_shingles)
    blocks = texts.join(blocks.hint("shuffle_hash"), ["doc_id", "tid"])  # grows with the corpus: not to be broadcast

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, a, b = table.column("node").to_numpy(), [], []
        stops = np.append(starts[1:], len(node))
        for lo, hi in zip(starts.tolist(), stops.tolist()):
            texts = table.column("text").slice(lo, hi - lo).combine_chunks()
            texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
            near = similar([s for s, _ in shingle_sets(texts, cfg)], cfg.similarity)
            for i, j in spanning_forest(hi - lo, near):
                a.append(node[lo + i])
                b.append(node[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_groups(blocks.select("family", "block_a", "block_b", "node", "text"), ["family", "block_a", "block_b"],
                      run, "a long, b long")


def similar(sets: list[np.ndarray], percent: int):
    """near(i, others) for ``spanning_forest``: 100 * intersection >= percent * union, counted exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    where = np.concatenate([[0], np.cumsum(sizes)])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(dense), np.int64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fit = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        out = np.zeros(len(others), bool)
        those = others[fit]
        if not len(those):
            return out
        own = dense[where[i]:where[i + 1]]
        marked[own] = 1
        n = sizes[those]
        place = np.repeat(where[those] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.add.reduceat(marked[dense[place]], np.concatenate([[0], np.cumsum(n)[:-1]]))
        marked[own] = 0
        out[fit] = 100 * common >= percent * (n + sizes[i] - common)
        return out

    return near


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. Rows that share a doc_id are each judged
    by their own text: a group is one of word sequences, and its component_id the smallest doc_id of their rows. A row without doc_id can't name a component: it links with nothing, has a null
    component and is kept. Other columns are ignored.
    """
    return _judged(docs, cfg).drop("tid")


def _judged(docs: DataFrame, cfg: NearDup) -> DataFrame:
    """``near_duplicates`` with tid, which tells the rows of one doc_id apart by their text."""
    sigs = stored(signatures(docs, cfg), "signatures")
    classes = text_classes(sigs)
    family = components(family_edges(classes, cfg)).withColumnsRenamed({"component": "family"})
    family = family.unionAll(family.select(F.col("family").alias("node"), "family").distinct())
    members = stored(classes.join(family, "node").select("family", "node", "doc_id", "tid", "n_shingles"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("tid"), "text")
    found = components(set_links(members, texts, cfg))
    found = found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
    linked = stored(classes.join(found, "node").select("h1", "h2", "doc_id", F.col("component").alias("group")), "linked")
    least = linked.groupBy("group").agg(F.min("doc_id").alias("component"))
    named = classes.select("h1", "h2", "doc_id").join(
        linked.join(least, "group").select("h1", "h2", "component"), ["h1", "h2"], "left").select(
        "h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sigs.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "tid")


def one_of_each(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """Rows of ``docs`` (columns as they are) but for near-duplicates of a document with a smaller doc_id.

    Of rows that share a doc_id, each stays or goes by its own text.
    """
    gone = _judged(docs, cfg).filter("not kept").select(F.col("doc_id").alias("_nd_doc"), F.col("tid").alias("_nd_tid")).distinct()
    return docs.join(
        gone.hint("shuffle_hash"),
        (F.col("doc_id").cast("long") == F.col("_nd_doc")) & (text_id(F.col("text")) == F.col("_nd_tid")), "left_anti")
