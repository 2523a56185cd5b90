"""Spans of a text: tuples that begin with start and end, end exclusive."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate


def apart_from(added: list[tuple], base: list[tuple]) -> list[tuple]:
    """The spans that overlap none of ``base``, whose spans are in the order of their starts."""
    starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    return [s for s in added if not (n := bisect_left(starts, s[1])) or reach[n - 1] <= s[0]]
