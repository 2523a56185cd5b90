"""Private data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels the words of each line (outside, or first or later word of an
email, ip, card, phone or id) and adds spans that no pattern has. Words are described by their shape: runs of
characters with the lengths of digit runs, and a few context words. A batch is decoded at once: words become
numbers of distinct shapes, and Viterbi runs over all lines in step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.kernels import LOWER, pieces, span_hashes, utf8, word_spans
from panelmill.llm.pii_table import labelled_rows
from panelmill.llm.spans import apart_from

KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
# Runs are taken whole, matched or not (group 1), so that a long run is read once and not again from each of its places.
EMAIL = re.compile(r"([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)|[A-Za-z0-9._%+-]++")
IP = re.compile(r"([0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++))|[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KEYWORDS = ("call", "phone", "tel", "telephone", "mobile", "fax", "ring", "text", "contact", "number", "email", "mail",
            "write", "card", "visa", "amex", "credit", "ssn", "social", "security", "id", "server", "ping", "host", "ip",
            "version", "license", "isbn", "order", "invoice", "ticket", "page", "pages", "password", "token", "hash")
TRIM = np.zeros(256, bool)
TRIM[[ord(c) for c in "\"'.,;:!?*#$%&<>{}[]|"]] = True
#: Class of each byte: letters a and A, digits 9, bytes of non-ASCII characters u, every other byte itself.
KIND_OF = np.arange(256, dtype=np.int64)
KIND_OF[ord("a"):ord("z") + 1], KIND_OF[ord("A"):ord("Z") + 1] = ord("a"), ord("A")
KIND_OF[ord("0"):ord("9") + 1], KIND_OF[128:] = ord("9"), ord("a")
PLAIN = np.uint64(0)
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_byte(digits: str) -> bool:
    """At most 255, for a number of any length."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if m[1] and all(map(is_byte, m[1].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


@dataclass
class Words:
    """Words of some lines: byte spans without outer signs, shape keys, and the lines' first words."""

    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    line: np.ndarray


@lru_cache(maxsize=1)
def _keyword_hashes() -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join(KEYWORDS).encode(), np.uint8)
    end = np.cumsum([len(k) for k in KEYWORDS])
    hashes = span_hashes(raw, end - [len(k) for k in KEYWORDS], end)
    order = np.argsort(hashes)
    return hashes[order], order


def read_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Words of the texts that begin at ``at``; a line ends at a line feed or a text's end."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start, end, _ = word_spans(~blank, at)
    breaks = np.union1d(np.flatnonzero(raw == 10), at[1:-1])
    line = np.concatenate([[0], np.flatnonzero(np.diff(np.searchsorted(breaks, start, "right"))) + 1]) if len(start) else start
    begin, start, end = start, start.copy(), end.copy()
    while len(start):
        move = (start < end) & TRIM[raw[np.minimum(start, len(raw) - 1)]]
        start += move
        back = (start < end) & TRIM[raw[end - 1]]
        end -= back
        if not (move.any() or back.any()):
            break
    bare = start >= end  # a word of signs alone keeps its place
    start[bare] = end[bare] = begin[bare]
    return Words(start, end, _shape_keys(raw, start, end), line)


def _shape_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """PLAIN for words of letters only that are no keywords, else a hash of the runs (and of the keyword)."""
    kind = KIND_OF[raw]
    letter = (kind == ord("a")) | (kind == ord("A"))
    count = np.concatenate([[0], np.cumsum(letter)])
    plain = count[end] - count[start] == end - start
    key = np.full(len(start), PLAIN)
    hashes, order = _keyword_hashes()
    short = np.flatnonzero(plain & (end - start <= 10) & (end > start))
    if len(short):
        own = span_hashes(LOWER[raw], start[short], end[short])
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[place] == own
        key[short[hit]] = (order[place[hit]] + 1).astype(np.uint64)
    odd = np.flatnonzero(~plain | (end == start))
    if len(odd):
        runs = np.concatenate([[True], kind[1:] != kind[:-1]])
        runs[start[odd]] = True
        runs[end[odd][end[odd] < len(raw)]] = True
        first = np.flatnonzero(runs)
        size = np.minimum(np.diff(np.append(first, len(raw))), 20)
        value = kind[first] * 32 + np.where(letter[first], 0, size)
        key[odd] = span_hashes(value, np.searchsorted(first, start[odd]), np.searchsorted(first, end[odd])) | np.uint64(1 << 63)
    return key


def features(word: str) -> list[str]:
    """Features of a word without outer signs, from what ``_shape_keys`` hashes alone: words of one key have the same
    features, so a span does not depend on which of them a task meets first."""
    low = word.translate(ASCII_LOWER)
    if low in KEYWORDS:
        return ["bias", f"key={low}"]
    shape = re.sub(r"[0-9]+", lambda m: f"9{{{min(len(m[0]), 20)}}}", re.sub(r"[A-Z]+", "A", re.sub(r"(?:[a-z]|[^\x00-\x7f])+", "a", word)))
    if re.fullmatch(r"[aA]*", shape) and word:
        return ["bias", "plain"]
    shape = re.sub(r"([^aA9])\1{20,}", lambda m: m[0][:20], shape)
    digits, letters = sum(min(len(m), 20) for m in re.findall("[0-9]+", word)), len(re.findall("[aA]", shape))
    return ["bias", f"shape={shape}", f"runs={re.sub('{[0-9]+}', '', shape)}", f"digits={min(digits, 20)}",
            f"letters={min(letters, 3)}", f"mixed={digits > 0}{letters > 0}{'@' in word}", f"dots={min(word.count('.'), 4)}{'@' in word}",
            f"dashes={min(word.count('-'), 4)}", f"first={shape[:1]}", f"last={shape[-1:].replace('}', '9')}"]


@dataclass
class Field:
    """Weights: per feature and place (0 own, 1 of the word before, 2 of the word after), and per label pair."""

    index: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((3, 0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(len(LABELS)))

    def local(self, word: str) -> np.ndarray:
        """What a word adds to its own label, to that of the next word and to that of the one before."""
        known = [self.index[f] for f in features(word) if f in self.index]
        return self.weight[:, known].sum(axis=1)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """0 or a forbidding weight: a later word follows a first or later one of its kind."""
    move, begin = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            begin[j] = -1e4
            move[[i for i, before in enumerate(LABELS) if before[2:] != label[2:]], j] = -1e4
    return move, begin


def train(rows: Sequence[tuple[str, Sequence[tuple[str, int, int]]]], steps: int = 120, rate: float = 0.2,
          penalty: float = 0.05) -> Field:
    """Penalised maximum likelihood by Adam over all rows at once; rows are (text of one line, spans)."""
    words, gold = [], []
    for text, spans in rows:
        raw, at = utf8(pa.array([text]))
        w = read_words(raw, at)
        words.append([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(w.start, w.end)])
        label = [0] * len(words[-1])
        for kind, start, end in spans:
            start, end = len(text[:start].encode()), len(text[:end].encode())
            own = [i for i, (a, b) in enumerate(zip(w.start, w.end)) if a < end and b > start]
            for n, i in enumerate(own):
                label[i] = LABELS.index(("I-" if n else "B-") + kind)
        gold.append(label)
    index = {f: i for i, f in enumerate(sorted({f for line in words for w in line for f in features(w)}))}
    n, longest, k = len(words), max(map(len, words)), len(LABELS)
    mask, y = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, line in enumerate(gold):
        mask[i, :len(line)], y[i, :len(line)] = True, line
    own = np.zeros((mask.sum(), len(index)))
    for row, w in zip(own, (w for line in words for w in line)):
        row[[index[f] for f in features(w)]] = 1
    inner = mask.copy()
    inner[:, 0] = False
    follows = inner[mask]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[follows], after[np.flatnonzero(follows) - 1] = own[np.flatnonzero(follows) - 1], own[follows]
    places = np.stack([own, before, after])
    forbid, no_start = _allowed()
    hot = np.eye(k)[y] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    par = [np.zeros((3, len(index), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for step in range(1, steps + 1):
        score = np.zeros((n, longest, k))
        score[mask] = (places @ par[0]).sum(axis=0)
        move, begin = par[1] + forbid, par[2] + no_start
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + begin
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + move, 1) + score[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        total = _logsum(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        double = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        miss = hot - single
        slope = [places.transpose(0, 2, 1) @ miss[mask], pairs - double.sum(axis=(0, 1)), miss[:, 0].sum(axis=0)]
        for p, g, m, v in zip(par, slope, first, second):
            g = g - penalty * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (0.99**step)
    return Field(index, par[0], par[1] + forbid, par[2] + no_start)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Decodes batches with a trained field."""

    def __init__(self, model: Field):
        self.model = model
        self.known: dict[int, int] = {}
        self.rows: list[np.ndarray] = []

    def _types(self, raw: np.ndarray, w: Words) -> np.ndarray:
        """Number of each word's type, whose weights are in ``rows``."""
        if len(self.rows) > 200_000:
            self.known, self.rows = {}, []
        keys, first, inverse = np.unique(w.key, return_index=True, return_inverse=True)
        numbers = np.empty(len(keys), np.int64)
        for i, (key, f) in enumerate(zip(keys.tolist(), first.tolist())):
            if key not in self.known:
                self.known[key] = len(self.rows)
                self.rows.append(self.model.local(bytes(raw[w.start[f]:w.end[f]]).decode("utf-8", "replace")))
            numbers[i] = self.known[key]
        return numbers[inverse]

    def spans(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(first byte, end byte, kind) in all texts, in order."""
        w = read_words(raw, at)
        if not len(w.start):
            return
        types, length = self._types(raw, w), np.diff(np.append(w.line, len(w.start)))
        odd = np.add.reduceat(w.key != PLAIN, w.line) > 0
        lines = np.concatenate([np.flatnonzero(odd), self._one_of_each(length, ~odd)])
        lines = lines[np.argsort(-length[lines], kind="stable")]
        table = np.stack(self.rows)
        label = np.zeros(len(types), np.int8)
        lo = 0
        while lo < len(lines):
            hi = lo + max(1, int(2_000_000 // (length[lines[lo]] * len(LABELS))))
            self._viterbi(table, types, w.line[lines[lo:hi]], length[lines[lo:hi]], label)
            lo = hi
        for start, end, kind in self._runs(label, w):
            yield int(w.start[start]), int(w.end[end]), kind

    def _one_of_each(self, length: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Lines of plain words differ only in length: one of each is decoded, and must be all outside."""
        own = np.flatnonzero(plain)
        return own[np.unique(length[own], return_index=True)[1]]

    def _viterbi(self, table: np.ndarray, types: np.ndarray, first: np.ndarray, length: np.ndarray, label: np.ndarray) -> None:
        """Best labels of lines, longest first; step t works on the lines that have a t-th word."""
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
        back = np.zeros((longest, len(first), len(LABELS)), np.int8)
        score = np.empty((len(first), len(LABELS)))
        for t in range(longest):
            n = int(active[t])
            here = first[:n] + t
            own = table[types[here], 0].copy()
            if t:
                own += table[types[here - 1], 1]
            more = int(active[t + 1]) if t + 1 < longest else 0
            own[:more] += table[types[here[:more] + 1], 2]
            if t:
                ways = score[:n, :, None] + self.model.move
                back[t, :n] = ways.argmax(axis=1)
                score[:n] = ways.max(axis=1) + own
            else:
                score[:n] = self.model.begin + own
        best = score.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = int(active[t])
            label[first[:n] + t] = best[:n]
            if t:
                best[:n] = back[t, np.arange(n), best[:n]]

    def _runs(self, label: np.ndarray, w: Words) -> Iterator[tuple[int, int, str]]:
        marked = np.flatnonzero(label)
        start = None
        for i in marked.tolist():
            name = LABELS[label[i]]
            if name[0] == "B":
                if start is not None:
                    yield start, last, kind
                start, kind = i, name[2:]
            last = i
        if start is not None:
            yield start, last, kind


@lru_cache(maxsize=1)
def built_in() -> Field:
    """The field trained on the built-in table."""
    return train(labelled_rows())


def find(docs: DataFrame, model: Field | None = None, piece_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind; code points, end exclusive) of every whole text.

    ``spans`` has the base spans and those of the field that overlap none of them, by start, then kind. A null
    or empty text has none. Lines without a number-like word can't differ from the few that are decoded. The
    field is trained here on the built-in table unless one is given. Rows keep their number and doc_id.
    """
    model = model or built_in()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            column = batch.column("text").fill_null("")
            raw, at = utf8(column)
            added: dict[int, list[tuple[int, int, str]]] = {}
            for lo, hi in pieces(at, piece_bytes):
                part, off = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                points = None
                for a, b, kind in tagger.spans(part, off):
                    if points is None:
                        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    doc = int(np.searchsorted(off, a, "right")) - 1
                    zero = points[off[doc]]
                    added.setdefault(lo + doc, []).append((int(points[a] - zero), int(points[b] - zero), kind))
            base, every = [], []
            for i, text in enumerate(column.to_pylist()):
                own = base_spans(text)
                more = apart_from(added.get(i, []), own)
                base.append([dict(zip(("start", "end", "kind"), s)) for s in own])
                every.append([dict(zip(("start", "end", "kind"), s)) for s in sorted(own + more, key=_order)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, shape), pa.array(every, shape)], ["doc_id", "base", "spans"])
    kind = "array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
