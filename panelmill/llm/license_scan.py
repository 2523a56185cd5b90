"""License notices in texts: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts become words. Hashes of ``gram`` consecutive words are winnowed: of every ``window`` of them
the least is kept (the last of equals), so a stretch of ``gram + window - 1`` words that a text shares with a template gives
a shared fingerprint. With the defaults that is four words, which every template of 16 words or more has left in a row
where a fifth of its words is changed; a shorter one may have two, so of these every gram of two counts. An inverted index of
the templates' fingerprints, whose size depends on the templates alone, leads to candidate places; there, the template is
aligned with the text in a band around the diagonal. Where words were put in, the stretches on both sides lie on other
diagonals: stretches in the order of the template, up to ``gap`` words apart in the text, are chained, aligned one after the
other, and their matched words added up. Matches that lie over each other compete, so that of the variants of a notice only
the closest is given.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.kernels import LOWER, mix, pieces, span_hashes, utf8, word_spans
from panelmill.llm.license_table import REQUIRED, TEMPLATES

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Scan:
    """``band`` is how far an alignment may leave its diagonal and ``gap`` how many words may stand between two aligned
    stretches; matches under ``least`` coverage are dropped. Templates of fewer than ``short`` words have grams of
    ``short_gram`` words (or as many as they have), of which all count."""

    gram: int = 3
    window: int = 2
    short: int = 16
    short_gram: int = 2
    band: int = 8
    gap: int = 200
    least: float = 0.8

    def of(self, words: int) -> Scan:
        """The lengths of gram and window for a template of so many words."""
        return replace(self, gram=min(self.short_gram, words), window=1) if words < self.short else self


@dataclass
class TemplateIndex:
    """Word hashes of each template, the phrases (word hashes) that its matches must hold, the gram and window lengths in use, and
    fingerprint -> (template, word) of all templates."""

    names: list[str] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    phrases: list[list[list[int]]] = field(default_factory=list)
    grams: set[tuple[int, int]] = field(default_factory=set)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, end, first word of each text) of the words (runs of letters and digits, A-Z lower-cased)."""
    start, end, first = word_spans(IS_WORD[raw], at)
    return span_hashes(LOWER[raw], start, end), start, end, first


def winnow(words: np.ndarray, cfg: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, word) of the grams that are least in some window; with fewer grams than a window, the least."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(cfg.gram, len(words))
    n = len(words) - gram + 1
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n])
    window = min(cfg.window, n)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    chosen = np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))
    return grams[chosen], chosen


def template_index(templates: Mapping[str, str], cfg: Scan, required: Mapping[str, list[str]] | None = None) -> TemplateIndex:
    index = TemplateIndex()
    for name, text in templates.items():
        hashes, *_ = word_hashes(*utf8(pa.array([text])))
        if not len(hashes):
            continue
        own = cfg.of(len(hashes))
        for print_, place in zip(*(x.tolist() for x in winnow(hashes, own))):
            index.places[print_].append((len(index.names), place))
        index.grams.add((own.gram, own.window))
        index.names.append(name)
        index.words.append(hashes)
        index.phrases.append([word_hashes(*utf8(pa.array([p])))[0].tolist() for p in (required or {}).get(name, ())])
    return index


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first and last text word + 1) of the longest common subsequence near the diagonal.

    Row i is the template's word; its columns are the text words i + shift - band .. i + shift + band. Of equal
    alignments, the one that begins last is taken, so that the span is tight.
    """
    width = 2 * band + 1
    none = (0, 1, 0)
    before = [none] * (width + 1)
    best = none
    for i, word in enumerate(template.tolist()):
        row, left = [none] * (width + 1), none
        for k in range(width):
            j = i + shift - band + k
            if 0 <= j < len(text):
                value = max(left, before[k + 1])
                if text[j] == word:
                    n, start, _ = before[k]
                    value = max(value, (n + 1, start if n else -j, j + 1), key=lambda v: (v[0], v[1], -v[2]))
                row[k] = left = value
            else:
                row[k] = left
        best = max(best, *row[:width], key=lambda v: (v[0], v[1], -v[2]))
        before = [*row[:width], none]
    return best[0], -best[1] if best[0] else 0, best[2]


def holds(words: list[int], phrase: list[int]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


@dataclass
class Stretch:
    """Template words ``own``..``own_end`` at the text words ``place``..``end``, all on one diagonal."""

    own: int
    own_end: int
    place: int
    end: int


def stretches(hits: list[tuple[int, int]], gram: int, band: int) -> list[Stretch]:
    """Hits (text word, template word) of one template, joined where they are on one diagonal within ``band`` words; by place."""
    out: list[Stretch] = []
    last: dict[int, Stretch] = {}
    for place, own in sorted(hits):
        open_ = last.get(place - own)
        if open_ is not None and place <= open_.end + band:
            open_.own_end, open_.end = own + gram, place + gram
        else:
            last[place - own] = Stretch(own, own + gram, place, place + gram)
            out.append(last[place - own])
    return out


def chains(parts: list[Stretch], gap: int) -> list[list[Stretch]]:
    """Heaviest chains of two stretches or more, in the order of template and text, at most ``gap`` words apart; a stretch is
    in one chain. A stretch looks back at those that end within ``gap`` words, so the work grows with the hits."""
    weight = [p.own_end - p.own for p in parts]
    before = [-1] * len(parts)
    first = 0
    longest = max((p.end - p.place for p in parts), default=0)
    for k, part in enumerate(parts):
        while parts[first].place < part.place - gap - longest:
            first += 1
        own = weight[k]
        for j in range(first, k):
            apart = part.place - parts[j].end
            if 0 <= apart <= gap and parts[j].own_end <= part.own and weight[j] + own > weight[k]:
                weight[k], before[k] = weight[j] + own, j
    used, out = [False] * len(parts), []
    for k in sorted(range(len(parts)), key=lambda k: (-weight[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(parts[k])
            k = before[k]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def align_chain(template: np.ndarray, words: np.ndarray, chain: list[Stretch], band: int) -> tuple[int, int, int]:
    """(matched words, first and last text word + 1) of a chain: each stretch aligned with the template from its own first
    word to that of the next, in the text up to the next. A stretch is first led back as far as its words agree."""
    own = [0] + [p.own for p in chain[1:]]
    place = [max(0, chain[0].place - chain[0].own - band)] + [p.place for p in chain[1:]]
    for k, prior in enumerate(chain[:-1], 1):
        while own[k] > prior.own_end and place[k] > prior.end and template[own[k] - 1] == words[place[k] - 1]:
            own[k], place[k] = own[k] - 1, place[k] - 1
    own.append(len(template))
    place.append(min(len(words), chain[-1].end + len(template) - chain[-1].own_end + band))
    total, start, end = 0, None, 0
    for k, part in enumerate(chain):
        text = words[place[k]:place[k + 1]].tolist()
        n, low, high = align(template[own[k]:own[k + 1]], text, part.place - part.own + own[k] - place[k], band)
        if n:
            total, start, end = total + n, place[k] + low if start is None else start, place[k] + high
    return total, start or 0, end


def compete(found: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
    """The matches that stay, best first. They are kept by first word, and a match is held only against those near it."""
    out: list[tuple[int, float, int, int, int]] = []
    starts: list[tuple[int, int]] = []
    longest = max((m[3] - m[2] for m in found), default=0)
    for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[3], m[0])):
        near = starts[bisect_left(starts, (m[2] - longest, -1)):bisect_left(starts, (m[3], -1))]
        for _, i in near:
            words = min(out[i][3], m[3]) - max(out[i][2], m[2])
            if words > 0 and (out[i][0] == m[0] or 2 * words > min(out[i][3] - out[i][2], m[3] - m[2])):
                break
        else:
            insort(starts, (m[2], len(out)))
            out.append(m)
    return out


def matches(words: np.ndarray, index: TemplateIndex, cfg: Scan, known: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, last word + 1) of the notices in one text.

    Matches of one template do not overlap. Of two templates' matches that share more than half of the shorter one, that
    with more matched words stays, then that with the greater coverage.
    """
    near: dict[tuple[int, int], int] = {}
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for gram, window in sorted(index.grams):
        prints, places = winnow(words, replace(cfg, gram=gram, window=window))
        hit = known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints
        for print_, place in zip(prints[hit].tolist(), places[hit].tolist()):
            for t, own in index.places[print_]:
                width = max(1, min(cfg.band, int(cfg.least * len(index.words[t]))))
                near.setdefault((t, (place - own) // width), place - own)
                hits[t].append((place, own))
    found = []

    def keep(t: int, n: int, start: int, end: int) -> None:
        if n >= cfg.least * len(index.words[t]):
            part = words[start:end].tolist()
            if all(holds(part, p) for p in index.phrases[t]):
                found.append((t, n / len(index.words[t]), start, end, n))

    def may_match(t: int, lo: int, hi: int) -> bool:
        template = index.words[t]
        if hi - lo < cfg.least * len(template):
            return False
        there = set(words[lo:hi].tolist())
        return all(there.issuperset(p) for p in index.phrases[t]) and sum(w in there for w in template.tolist()) >= cfg.least * len(template)

    for (t, _), shift in sorted(near.items()):
        parts = [(max(0, shift - cfg.band), min(len(words), shift + len(index.words[t]) + cfg.band))]
        while parts:  # beside a match, the rest of the place may hold another one
            lo, hi = parts.pop()
            if may_match(t, lo, hi):
                n, start, end = align(index.words[t], words[lo:hi].tolist(), shift - lo, cfg.band)
                if n >= cfg.least * len(index.words[t]):
                    keep(t, n, lo + start, lo + end)
                    parts += [(lo, lo + start), (lo + end, hi)]
    for t, own in hits.items():
        length = len(index.words[t])
        if length >= cfg.short:
            for chain in chains(stretches(own, cfg.gram, cfg.band), cfg.gap):
                if may_match(t, max(0, chain[0].place - chain[0].own - cfg.band),
                             min(len(words), chain[-1].end + length - chain[-1].own_end + cfg.band)):
                    keep(t, *align_chain(index.words[t], words, chain, cfg.band))
    return sorted((m[:4] for m in compete(found)), key=lambda m: (m[2], m[3], m[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, cfg: Scan = Scan(), piece_bytes: int = 1 << 21,
         required: Mapping[str, list[str]] | None = None) -> DataFrame:
    """doc_id, notices (array of license, coverage, start, end by start; code points, end exclusive) of every whole text.

    Coverage is the share of the template's words that the alignment matches; templates without words are ignored.
    ``required`` are phrases that a match of one of the given ``templates`` must hold. A null or empty text has no notices. Rows keep their number and doc_id, null or repeated; other columns are ignored.
    The templates and their index go to every task; their size does not depend on the documents.
    """
    index = template_index(TEMPLATES, cfg, REQUIRED) if templates is None else template_index(templates, cfg, required)
    known = np.array(sorted(index.places), np.uint64)
    names = ("license", "coverage", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64())))))
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            notices: list[list[dict]] = []
            for lo, hi in pieces(at, piece_bytes):
                part, off = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                hashes, start, end, first = word_hashes(part, off)
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    zero = points[off[d]]
                    notices.append([
                        dict(zip(names, (index.names[t], cover, int(points[start[a + s]] - zero), int(points[end[a + e - 1]] - zero))))
                        for t, cover, s, e in matches(hashes[a:b], index, cfg, known)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(notices, shape)], ["doc_id", "notices"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, notices array<struct<license:string,coverage:double,start:long,end:long>>")
