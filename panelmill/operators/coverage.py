"""How many entities there are and how much of the calendar each one covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import day, span_days


def entity_counts(df: DataFrame, by: Sequence[str] = (), entity: str = "code") -> DataFrame:
    """Distinct entities, overall or per group, most frequent first. A missing code counts as one."""
    counted = df.select(*by, entity).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), *[F.asc_nulls_last(c) for c in by]) if by else counted


def spans(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last date and the days between, per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.max("date").alias("latest"), F.min("date").alias("earliest"),
    ).withColumn("length", span_days(F.col("latest"), F.col("earliest")))


def calendar_coverage(df: DataFrame) -> DataFrame:
    """Distinct dates of the whole table and the span they cover."""
    return spans(df.select("date").distinct())


def entity_coverage(df: DataFrame, by: Sequence[str] = ("code", "fund_type", "category")) -> DataFrame:
    """Span per entity and rows per day of it, sparsest first; no ratio for a single-day span."""
    return (
        spans(df, by).withColumn("coverage", F.try_divide("count", "length"))
        .orderBy(F.asc_nulls_last("coverage"), *[F.asc_nulls_last(c) for c in by])
    )


def history_years(df: DataFrame) -> DataFrame:
    """Number of codes per full year of history."""
    years = F.floor(F.col("length") / 365).cast("int").alias("length_years")
    return spans(df, ["code"]).groupBy(years).agg(F.count(F.lit(1)).alias("codes")).orderBy("length_years")


def min_history(df: DataFrame, cutoff: str, by: Sequence[str] = ("code",)) -> DataFrame:
    """Span of the entities that have data on the cutoff date or before it."""
    return (
        spans(df, by).filter(F.col("earliest") <= day(cutoff))
        .orderBy(F.desc_nulls_last("earliest"), *[F.asc_nulls_last(c) for c in by])
    )
