"""Snapshots of one date and equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.functions.numeric import histogram_bin


def histogram(df: DataFrame, value: str, facet: str, bins: int = 50) -> DataFrame:
    """Rows per facet and bin; all facets share the bin edges. Empty bins and missing values are left out.

    The range is a one-row subquery. It reads the columns the count reads, so where both need the
    same shuffle below, Spark runs it once.
    """
    rows = df.filter(F.col(value).isNotNull()).select(facet, F.col(value).alias("value"))
    per_facet = rows.groupBy(facet).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    limits = per_facet.agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high"))).scalar()
    number = histogram_bin(F.col("value"), limits["low"], limits["high"], bins)
    return (
        rows.select(facet, number.alias("bin")).groupBy(facet, "bin").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.asc_nulls_last(facet), "bin")
    )


def snapshot(panel: DataFrame, date: str) -> DataFrame:
    """Rows of one date."""
    return panel.filter(F.col("date") == day(date))


def valuation_snapshot(panel: DataFrame, date: str) -> DataFrame:
    """Rows of one date with the total value in millions and in bins of ten million."""
    cents = F.col("total_value").cast("decimal(28,2)")
    return snapshot(panel, date).withColumns({
        "total_value_millions": F.round(cents / 1000000, 2).cast("double"),
        "total_value_bins": F.floor(F.col("total_value") / 10000000),
    })


def valuation_histogram(panel: DataFrame, date: str, bins: int = 50) -> DataFrame:
    return histogram(valuation_snapshot(panel, date), "total_value_millions", "contribution", bins)


def investors_histogram(panel: DataFrame, date: str, bins: int = 50) -> DataFrame:
    return histogram(snapshot(panel, date), "people", "fund_type", bins)
