"""Returns and risk per entity, and their averages per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.functions.numeric import log10_positive, percent_change, simple_return
from panelmill.functions.windows import previous
from panelmill.operators.guards import single
from panelmill.schema import ENTITY


def daily_change_stats(panel: DataFrame, start: str, grace_days: int = 3,
                       by: Sequence[str] = ENTITY) -> DataFrame:
    """Mean and sample deviation of daily returns from ``start`` on, per entity.

    The first return of the period looks back to the last row before it. Of the older history only
    that one row per entity is needed, so it is reduced on the map side and never shuffled whole; two
    rows on its date are an error like any other repeated date. Entities that begin more than ``grace_days`` after ``start`` are left out.
    """
    begin = day(start)
    rows = panel.select(*by, "date", "price")
    last_before = last_rows(rows.filter(F.col("date") < begin), by)
    series = rows.filter(F.col("date") >= begin).unionByName(last_before)
    change = simple_return(F.col("price"), previous(F.col("price"), by))
    return (
        series.withColumn("daily_price_change", change)
        .filter(F.col("date") >= begin)
        .groupBy(*by).agg(
            F.avg("daily_price_change").alias("avg_daily_change"),
            F.stddev_samp("daily_price_change").alias("stdev"),
            F.min("date").alias("earliest"),
            F.count(F.lit(1)).alias("count"),
        )
        .filter(F.col("earliest") <= F.date_add(begin, grace_days))
    )


def last_rows(rows: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """Each entity's row on its last date; two rows on it are an error."""
    entity = Window.partitionBy(*by)
    last = rows.withColumn("_rank", F.rank().over(entity.orderBy(F.desc_nulls_last(order)))).filter("_rank = 1")
    counted = last.withColumn("_rows", F.count(F.lit(1)).over(entity))
    return single(counted, "_rows", f"duplicate of the last {order}", *by, order).drop("_rank")


def annual_change(panel: DataFrame, first: str, last: str, by: Sequence[str] = ENTITY) -> DataFrame:
    """Return between two anchor dates, for entities that have a price on both."""
    anchors = panel.filter(F.col("date").isin(day(first), day(last)))
    change = simple_return(F.col("price"), previous(F.col("price"), by))
    return anchors.withColumn("annual_change", change).filter(F.col("annual_change").isNotNull())


def risk_return(annual: DataFrame, daily: DataFrame, base: str = "annual") -> DataFrame:
    """Daily statistics and annual change side by side, one row per entity of the ``base`` side.

    Adds base-10 logarithms for log axes; they are missing where a value is not positive.
    """
    change, stats = "annual_change", ("avg_daily_change", "stdev")
    if base == "annual":
        joined = annual.join(daily.select("code", *stats), "code", "left")
    elif base == "daily":
        joined = daily.join(annual.select("code", change), "code", "left")
    else:
        raise ValueError(f"base must be 'annual' or 'daily', not {base!r}")
    return joined.withColumns({f"log_{c}": log10_positive(F.col(c)) for c in (change, *stats)})


def risk_return_by(risk: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unweighted mean of the entities' figures per group."""
    figures = ("avg_daily_change", "stdev", "annual_change")
    return risk.groupBy(*by).agg(*[F.avg(c).alias(c) for c in figures])


def risk_return_by_category(risk: DataFrame) -> DataFrame:
    return risk_return_by(risk, ("category", "fund_type"))


def risk_return_by_company(risk: DataFrame) -> DataFrame:
    return risk_return_by(risk, ("company_name", "fund_type"))


def subset(df: DataFrame, **values: Any) -> DataFrame:
    """Rows whose columns hold the given value, or one of the given list."""
    for column, wanted in values.items():
        options = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        df = df.filter(F.col(column).isin(*options))
    return df


def monthly_returns(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Adds the change of the closing price on the entity's month before, for months from ``start`` to ``end``.

    Both bounds are below the window: later months aren't read, and of the earlier ones only each entity's
    last close is kept, to which the first return of the period looks back.
    """
    if end is not None:
        panel = panel.filter(F.col("date") <= day(end))
    if start is not None:
        begin = day(start)
        before = last_rows(panel.filter(F.col("date") < begin), ["code"])
        panel = panel.filter(F.col("date") >= begin).unionByName(before)
        return monthly_returns(panel).filter(F.col("date") >= begin)
    return panel.withColumn("monthly_price_change", simple_return(F.col("price"), previous(F.col("price"), ["code"])))


def two_date_compare(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Price and total value on the later date against the earlier one, with percent changes.

    Entities without a row on the earlier date stay, without previous values.
    """
    by = ("code", "name")
    price, total = F.col("price"), F.col("total_value")
    anchors = panel.filter(F.col("date").isin(day(first), day(last)))
    before: Mapping[str, Any] = {
        "previous_price": previous(price, by), "previous_total_value": previous(total, by)}
    return (
        anchors.withColumns(dict(before)).filter(F.col("date") == day(last))
        .select(
            "date", "fund_type", "category", "code", "name", "price", "previous_price",
            percent_change(price, F.col("previous_price")).alias("change_price_percentage"),
            "total_value", "previous_total_value",
            percent_change(total, F.col("previous_total_value")).alias("change_total_value_percentage"),
        )
    )
