"""Numpy helpers over a whole Arrow batch of texts at once: bytes, words and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins (one more entry for the end); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes together; a longer text is alone in its range."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


@lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    def table(base: int) -> np.ndarray:
        out = np.ones(length, np.uint64)
        have, step = 1, base
        while have < length:
            more = min(have, length - have)
            out[have:have + more] = out[:more] * np.uint64(step)
            have, step = have + more, step * step & _MASK
        return out
    return table(BASE), table(pow(BASE, -1, 1 << 64))


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    forward, back = _powers(1 << max(16, (length - 1).bit_length()))
    return forward[:length], back[:length]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``values[start:end]``, from one running sum over all values."""
    forward, back = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that end at text borders: start, end, and the index of the first run of each text."""
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    if len(is_word):
        before[0] = after[-1] = False
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        borders = at[1:-1]
        before[borders[borders < len(is_word)]] = False
        after[borders[borders > 0] - 1] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(start, at)
