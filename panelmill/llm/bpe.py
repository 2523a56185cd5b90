"""Byte-level BPE by replaying the merges over all distinct pieces of a corpus part at once.

An inverted index leads from the rank of a pair of neighbouring tokens to its places in the pieces. Ranks are
taken in ascending order; all places of a rank are merged together, and only the pairs with the touched
neighbours enter the index anew. Documents then look their pieces up. The corpus is dealt to tasks by its
rows; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.pretokens import PieceEncoder

NEVER = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 and rank on each line) in the order of their ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class MergeReplay:
    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens)}
        self.tokens = tokens
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left << 32 | right, i) for i, token in enumerate(tokens) for cut in range(1, len(token))
                 if (left := rank.get(token[:cut])) is not None and (right := rank.get(token[cut:])) is not None]
        keys, ranks = np.array(pairs, np.int64).T
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order].astype(np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NEVER)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        raw = [p.encode() for p in pieces]
        length = np.array([len(r) for r in raw], np.int64)
        n = int(length.sum())
        token = np.empty(n + 1, np.int32)
        token[:n] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        token[n] = -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(length)
        after[ends - 1] = n
        before[ends - length] = n
        rank = np.full(n + 1, NEVER, np.int32)
        live = np.flatnonzero(after[:n] < n)
        rank[live] = self.pair_ranks(token[live], token[after[live]])
        index: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Files the places under the rank of their pair."""
            own = rank[places]
            keep = own != NEVER
            places, own = places[keep], own[keep]
            if not len(own):
                return
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(own)]
            for lo, hi, r in zip(bounds[:-1], bounds[1:], own[[0, *cuts.tolist()]].tolist()):
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(todo, r)

        enter(live)
        while todo:
            r = heapq.heappop(todo)
            found = index.pop(r)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[rank[places] == r]
            if not len(places):
                continue
            second = after[places]
            if len(places) > 1 and (chained := second[:-1] == places[1:]).any():
                head = np.concatenate([[True], ~chained])
                since = np.arange(len(places)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                places = places[since % 2 == 0]
                second = after[places]
            third = after[second]
            token[places] = r
            token[second] = -1
            rank[second] = NEVER
            after[places] = third
            before[third] = places
            rank[places] = np.where(third < n, self.pair_ranks(token[places], token[third]), NEVER)
            prior = before[places]
            near = prior < n
            prior = prior[near]
            rank[prior] = self.pair_ranks(token[prior], token[places[near]])
            before[n] = after[n] = n
            rank[n] = NEVER
            enter(np.unique(np.concatenate([places, prior])))
        alive = token[:n] >= 0
        return token[:n][alive], np.add.reduceat(alive, ends - length) if len(length) else length


@lru_cache(maxsize=2)
def _replay(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every whole text; null is empty.

    ``rank_file`` must be readable on the executors. Rows keep their number and doc_id, null or repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(_replay(rank_file))
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            ids = pa.array([x.astype("<u4").tobytes() for x in encoder(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, bytes from the ids that ``encode_documents`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _replay(rank_file).tokens
        for batch in batches:
            out = [decode(np.frombuffer(x, "<u4"), tokens) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])
    return encoded.mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded, in one pass; ids on request."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(rank_file)
        encoder = PieceEncoder(replay)
        for batch in batches:
            size, one, two, ids = [], [], [], []
            for own in encoder(batch.column("text").fill_null("").to_pylist()):
                size.append(len(own))
                one.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(decode(own, replay.tokens)).hexdigest())
                ids += [own] * with_ids
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0)
                places = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(places, pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
