"""Texts split into the pieces that byte-level BPE encodes one by one, and each distinct piece encoded once.

The split is that of the usual pattern (contractions, words, numbers, other signs, blanks), found for a whole
chunk of texts at once from the runs of its character classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex

from panelmill.llm.kernels import span_hashes

OTHER, LETTER, NUMBER, BLANK = range(4)
CHUNK = 3_000_000
GROUP = 24_000_000
CACHE = 300_000
#: Second letters of contractions that stand after an apostrophe, by their first letter (0: none).
CONTRACTIONS = {"s": 0, "t": 0, "m": 0, "d": 0, "r": "e", "v": "e", "l": "l"}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start():m.end()] = kind
    return table


def piece_starts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each piece begins in the code points of texts that begin at ``at`` (its last entry is the end)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    border = np.zeros(n + 1, bool)
    border[at] = True
    begins = border.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins[:n])
    end = np.append(run[1:], n)
    starts = begins
    blank = (kind[run] == BLANK) & ~border[end]
    last = end[blank] - 1
    starts[last] = True
    starts[end[blank][codes[last] == 32]] = False
    mark = run[(codes[run] == 39) & (end - run == 1) & starts[run] & ~border[end]]
    for first, second in CONTRACTIONS.items():
        hit = mark[codes[mark + 1] == ord(first)]
        if second:
            hit = hit[(hit + 2 < n)]
            hit = hit[(codes[hit + 2] == ord(second)) & ~border[hit + 2]]
        starts[hit + 1] = False
        starts[hit + (3 if second else 2)] = True
    return np.flatnonzero(starts[:n])


def segments(texts: list[str], limit: int) -> Iterator[tuple[int, str]]:
    """(index, part) of each text; a longer one than ``limit`` is cut where blanks begin, so that no piece changes."""
    for i, text in enumerate(texts):
        while len(text) > limit:
            cut = next((m.start() + 1 for m in regex.finditer(r"\S\s", text, pos=limit // 2)), len(text))
            yield i, text[:cut]
            text = text[cut:]
        yield i, text


class PieceEncoder:
    """Ids of texts from ``encode``, which gives the ids of a list of distinct pieces in one array and their counts.

    Texts are taken in groups of bounded size; within one, every distinct piece is encoded once, and known
    pieces are kept for later groups until there are ``CACHE`` of them.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint32):
        self.encode, self.dtype = encode, dtype
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.off, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        ids, size = self.encode(new)
        off = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
        self.off, self.size = np.concatenate([self.off, off]), np.concatenate([self.size, size])

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > GROUP:
                yield from self._group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHE:
            self._forget()
        parts: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        new: list[str] = []
        chunk: list[tuple[int, str]] = []
        held = 0
        for i, part in segments(texts, CHUNK):
            if chunk and held + len(part) > CHUNK:
                parts.append(self._chunk(chunk, new))
                chunk, held = [], 0
            chunk.append((i, part))
            held += len(part)
        parts.append(self._chunk(chunk, new))
        self._learn(new)
        done, whole = 0, []
        for owners, word, at in parts:
            size = self.size[word]
            end = np.cumsum(size)
            ids = self.flat[np.repeat(self.off[word] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
            cut = np.concatenate([[0], end])[at]
            for k, i in enumerate(owners):
                if i != done:
                    yield np.concatenate(whole)
                    done, whole = i, []
                whole.append(ids[cut[k]:cut[k + 1]])
        yield np.concatenate(whole)

    def _chunk(self, chunk: list[tuple[int, str]], new: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Owners of the chunk's parts, the number of each piece, and the first piece of each part."""
        text = "".join(part for _, part in chunk)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(part) for _, part in chunk])])
        start = piece_starts(codes, at)
        end = np.append(start[1:], len(codes))
        first, inverse = distinct(codes, start, end)
        numbers = np.empty(len(first), np.int32)
        known = self.known
        for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist())):
            piece = text[a:b]
            number = known.get(piece)
            if number is None:
                number = known[piece] = len(known)
                new.append(piece)
            numbers[k] = number
        return [i for i, _ in chunk], numbers[inverse], np.searchsorted(start, at)


def distinct(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and the kind of each piece, by hash and then checked by all code points."""
    _, first, inverse = np.unique(span_hashes(codes, start, end), return_index=True, return_inverse=True)
    size, like = end - start, start[first][inverse]
    same = np.array_equal(size, size[first][inverse])
    if same and len(codes):
        there = np.repeat((like - start).astype(np.int32), size) + np.arange(len(codes), dtype=np.int32)
        same = np.array_equal(codes[there], codes)
    if same:
        return first, inverse
    kinds: dict[bytes, int] = {}
    inverse = np.array([kinds.setdefault(codes[a:b].tobytes(), len(kinds)) for a, b in zip(start, end)], np.int64)
    return np.unique(inverse, return_index=True)[1], inverse
