"""Ordered expressions over one entity's rows.

The panel key is (entity, date), one row per calendar day at most, so a window over one entity
holds at most 366 rows a year however large the table is. ``previous`` enforces that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def history(by: Sequence[str], order: str = "date") -> WindowSpec:
    """One entity's rows in time order."""
    return Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())


def previous(value: Column, by: Sequence[str], order: str = "date") -> Column:
    """The value on the entity's preceding row. Two rows on one date are an error."""
    over = history(by, order)
    repeated = F.lag(order).over(over) == F.col(order)
    failure = F.raise_error(F.concat(F.lit(f"duplicate ({', '.join(by)}, {order}) at "), F.col(order).cast("string")))
    return F.when(repeated, failure).otherwise(F.lag(value).over(over))


def indexed(value: Column, by: Sequence[str], order: str = "date") -> Column:
    """The value relative to the entity's first row."""
    whole = history(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.try_divide(value, F.first(value).over(whole))


def sequence_number(by: Sequence[str], order: str = "date") -> Column:
    """1, 2, 3, ... over the entity's rows in time order."""
    return F.row_number().over(history(by, order))


def cumulative_growth(gain: Column, by: Sequence[str], order: str = "date") -> Column:
    """Running product of ``1 + gain``. Missing gains are skipped, so fill or drop them before."""
    return F.product(gain + 1).over(history(by, order).rowsBetween(Window.unboundedPreceding, 0))


def expanding_risk(gain: Column, by: Sequence[str], order: str = "date") -> Column:
    """Population standard deviation of all gains up to and including the row."""
    return F.stddev_pop(gain).over(history(by, order).rowsBetween(Window.unboundedPreceding, 0))
