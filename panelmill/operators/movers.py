"""Rankings of the two-date comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("fund_type", "category", "code", "name", "previous_price", "price", "change_price_percentage")
MEASURE = "change_price_percentage"


def movers_table(compared: DataFrame) -> DataFrame:
    """All entities by price change, largest first, undefined changes last."""
    return compared.select(*COLUMNS).orderBy(F.desc_nulls_last(MEASURE), "code")


def top_movers(compared: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` largest price changes; ties go by code."""
    return movers_table(compared).limit(k)


def bottom_movers(compared: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` smallest price changes; ties go by code."""
    return compared.select(*COLUMNS).orderBy(F.asc_nulls_last(MEASURE), "code").limit(k)


def category_mix(ranked: DataFrame) -> DataFrame:
    """How often each category occurs in a ranking, most frequent first."""
    return (
        ranked.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("category"))
    )
