"""Benchmark series beside the panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.functions.numeric import rebase
from panelmill.operators.reshape import melt, spread
from panelmill.schema import BENCHMARKS, FLAGS

LABEL = "benchmark"
# What each series is divided by, and the name it is shown under.
BASES = {
    "tufe": ("b_tufe", 268.98),
    "usd": ("b_usd", 2.9248),
    "gold": ("b_gold", 99205.72),
    "xu100": ("b_xu100", 752.328),
    "property_index": ("b_property_index", 83.7),
    "deposit_rate": ("b_deposit_rate", 10.4525),
}
SHOWN = ("tufe", "usd", "gold", "xu100", "property_index")
FIRST_MONTH = "2015-11-01"


def benchmark_wide(series: DataFrame, names: Sequence[str] = BENCHMARKS, first: str = FIRST_MONTH,
                   drop_last: int = 2) -> DataFrame:
    """One row per month with a column per series, from ``first`` on, without the last months.

    ``series`` is all series in long form, so one aggregation replaces a chain of full outer joins.
    The rank from the end is not partitioned: it runs over one row per month.
    """
    wide = spread(series, ["date"], "name", "price", names).filter(F.col("date") >= day(first))
    from_end = F.row_number().over(Window.orderBy(F.desc("date")))
    return wide.withColumn("_from_end", from_end).filter(F.col("_from_end") > drop_last).drop("_from_end")


def benchmark_long(wide: DataFrame, names: Sequence[str] = BENCHMARKS) -> DataFrame:
    """Wide series as panel rows: each series is an entity of its own type."""
    return melt(wide, ["date"], names, "name", "price").select(
        "date", "name", "price", F.col("name").alias("code"),
        *[F.lit(LABEL).alias(c) for c in ("fund_type", "category", "company_code", "company_name")],
        *[F.lit(False).alias(c) for c in FLAGS],
    )


def panel_with_benchmarks(monthly: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Monthly panel and benchmark rows in one table, matched by column name."""
    return monthly.unionByName(benchmarks, allowMissingColumns=True)


def benchmark_rebased(wide: DataFrame, bases: Mapping[str, tuple[str, float]] = BASES,
                      shown: Sequence[str] = SHOWN) -> DataFrame:
    """Series relative to their base, in long form."""
    points = wide.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        *[rebase(F.col(column), base).alias(name) for name, (column, base) in bases.items()])
    return melt(points, ["date", "year", "month"], shown, "category", "points")


def by_shifted_month(wide: DataFrame, shift_days: int = 15) -> DataFrame:
    """Series keyed by the year and month that lie ``shift_days`` before their date.

    A month-start date moves into the month before, so a month is joined to the next month's value.
    Two rows for one month are an error: the result holds at most twelve rows per year.
    """
    shifted = F.date_sub("date", shift_days)
    series = [c for c in wide.columns if c != "date"]
    repeated = F.count(F.lit(1)) > 1
    return wide.groupBy(F.year(shifted).alias("year"), F.month(shifted).alias("month")).agg(
        *[F.when(repeated, F.raise_error(F.lit("two benchmark rows for one month"))).otherwise(F.max(c)).alias(c)
          for c in series])


def panel_join_benchmark(monthly: DataFrame, wide: DataFrame, shift_days: int = 15,
                         before: str = "2020-10-10") -> DataFrame:
    """Monthly panel up to a date, with the benchmark values of its (shifted) month.

    The benchmark side has one row per month, so it is broadcast; joining on the month by shuffle
    would put the whole panel on as many tasks as there are months.
    """
    months = by_shifted_month(wide, shift_days)
    series = [c for c in wide.columns if c != "date"]
    return (
        monthly.filter(F.col("data_date") < day(before)).join(F.broadcast(months), ["year", "month"], "left")
        .select(
            F.col("data_date").alias("date"), "year", "month", "fund_type", "category", "company_name",
            "company_code", "name", "code", "price", "total_value", "shares", *series)
    )
