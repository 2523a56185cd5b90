"""Small helpers shared by the query modules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.plans.views import Query


class Entry(NamedTuple):
    """A query and the SQL that gives the same result."""

    run: Query
    sql: str


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Floating sums depend on the order of addition, so they are compared to ``digits`` places."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_views(select: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select
