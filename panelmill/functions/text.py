"""Text expressions: null-safe matching, prefixes, transliteration to ASCII."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and marks whose ASCII form is not their base letter.
SINGLE = {
    "ı": "i", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ŋ": "n", "Ŋ": "N", "ſ": "s",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", "×": "*", "÷": "/",
}
EXPANDED = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ",
    "«": "<<", "»": ">>", "„": ",,", "…": "...",
}
# Blocks of accented Latin letters, by first code point and the one after the last.
ACCENTED = ((0x00C0, 0x0250), (0x1E00, 0x1F00))


def ascii_table() -> tuple[str, str]:
    """Source and target strings for ``translate``: accented Latin letters by Unicode decomposition."""
    table = dict(SINGLE)
    for code in (c for first, stop in ACCENTED for c in range(first, stop)):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            table[letter] = base
    return "".join(table), "".join(table.values())


def latin_ascii(text: Column) -> Column:
    """Latin text with every letter replaced by its plain ASCII form; text of single bytes stays as it is.

    Marks of their own after a letter, as in decomposed text, go, however many there are.
    """
    source, target = ascii_table()
    plain = F.regexp_replace(F.translate(text, source, target), r"([A-Za-z])\p{Mn}+", "$1")
    for letter, expansion in EXPANDED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(expansion))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern is found; a missing text does not match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def prefix(text: Column, length: int) -> Column:
    """The first ``length`` characters, or the whole text if it is shorter."""
    return F.substring(text, 1, length)
