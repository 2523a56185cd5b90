"""Daily rows reduced to the last one of each month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.dates import day, month_start
from panelmill.operators.guards import single

DROPPED_PREFIX = "p_"


def in_months(panel: DataFrame, *months: str) -> DataFrame:
    """Rows of the months that start on the given dates, as date ranges a scan can skip files by."""
    test = F.lit(False)
    for first in months:
        test = test | ((F.col("date") >= day(first)) & (F.col("date") < F.add_months(day(first), 1)))
    return panel.filter(test)


def monthly_close(panel: DataFrame) -> DataFrame:
    """Every column as of the entity's last row of the month, dated the first of the month.

    Ranking reduces rows on both sides of the shuffle: each task sends the last row of a code and month.
    Rows without a date close no month. Two rows on a closing date are an error.
    """
    kept = [c for c in panel.columns if c not in ("code", "date") and not c.startswith(DROPPED_PREFIX)]
    dated = panel.filter(F.col("date").isNotNull()).select(
        "code", "date", *kept, month_start(F.col("date")).alias("month_date"))
    month = Window.partitionBy("code", "month_date")
    last = dated.withColumn("rank", F.rank().over(month.orderBy(F.desc("date")))).filter("rank = 1")
    closed = single(last.withColumn("_rows", F.count(F.lit(1)).over(month)), "_rows", "row on a closing date", "code", "date")
    return closed.select(
        "code", F.year("month_date").alias("year"), F.month("month_date").alias("month"),
        F.col("date").alias("data_date"), *kept, F.col("month_date").alias("date"))


def month_end(series: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Last known value of each series per month, dated the first of the month."""
    known = series.filter(F.col("date").isNotNull() & F.col("price").isNotNull())
    return known.groupBy(*by, month_start(F.col("date")).alias("month_date")).agg(
        F.max("date").alias("data_date"), F.max_by("price", "date").alias("price"),
    ).withColumnRenamed("month_date", "date")
