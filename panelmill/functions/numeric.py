"""Arithmetic that must not fail under ANSI mode, and equal-width binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_return(value: Column, previous: Column) -> Column:
    """``value / previous - 1``; NULL where the previous value is zero or missing."""
    return F.try_divide(value, previous) - 1


def percent_change(value: Column, previous: Column) -> Column:
    """``100 * (value - previous) / previous``; NULL where undefined."""
    return F.try_divide((value - previous) * 100, previous)


def log10_positive(value: Column) -> Column:
    """Base-10 logarithm for a log axis, which leaves out values that are not positive."""
    return F.when(value > 0, F.log10(value))


def rebase(value: Column, base: float, digits: int = 2) -> Column:
    """``value`` relative to a constant base, rounded half up."""
    return F.round(F.try_divide(value, F.lit(float(base))), digits)


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1 of ``[low, high]`` cut into equal left-closed widths.

    Edge ``i`` is ``low + i * (high - low) / bins``; the last bin also holds ``high``.
    All values fall in bin 0 when the range is empty.
    """
    position = F.floor(F.try_divide(value - low, high - low) * bins).cast("int")
    return F.when(value.isNotNull(), F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)))


def equal_width_label(value: Column, low: Column, high: Column, labels: Sequence[str]) -> Column:
    """Label of the equal-width, right-closed class ``value`` falls in; ``low`` is in the first."""
    n = len(labels)
    rank = F.ceil(F.try_divide(value - low, high - low) * n).cast("int")
    rank = F.greatest(F.lit(1), F.coalesce(rank, F.lit(1)))
    return F.when(value.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in labels]), rank))
