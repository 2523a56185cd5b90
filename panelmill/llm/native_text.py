"""Column expressions on text that must treat only A-Z as letters with two cases."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit-class form (each separator on its own): Java tests it faster than ranges.
SEPARATORS = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{SEPARATORS}]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster way to the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, in their own case; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    return raw_words(lower_ascii(F.coalesce(text, F.lit(""))))


def text_id(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(text)
