"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text layouts of the source files.
DAY_MONTH_YEAR = "dd-MM-yyyy"
YEAR_MONTH = "yyyy-MM"
MONTH_YEAR = "MM-yyyy"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def day(text: str) -> Column:
    """Date literal from ``yyyy-MM-dd``."""
    return F.lit(text).cast("date")


def parse_date(text: Column, layout: str) -> Column:
    """Date from text; NULL for anything that does not fit the layout."""
    return F.try_to_timestamp(text, F.lit(layout)).cast("date")


def parse_timestamp(text: Column, length: int = 19, layout: str = ISO_SECONDS) -> Column:
    """Timestamp from the first ``length`` characters of ISO text.

    By default that is up to the second: what follows, a fraction or an offset, is ignored.
    """
    return F.try_to_timestamp(F.substring(text, 1, length), F.lit(layout))


def month_start(date: Column) -> Column:
    """First day of the date's month."""
    return F.trunc(date, "month")


def span_days(latest: Column, earliest: Column) -> Column:
    """Whole days between two dates."""
    return F.datediff(latest, earliest)
