"""Comparison queries built from parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.functions.windows import cumulative_growth, expanding_risk
from panelmill.operators.benchmark import LABEL

ALL = "ALL"
GROUPS = ("fund_type", "category", "company_name", "OKS", "contribution", "participation", "name")
METRICS = {"growth_rate": cumulative_growth, "stdev": expanding_risk}
BOTH = (True, False)


@dataclass(frozen=True)
class Comparison:
    """What to compare. Lists that hold ``"ALL"`` do not filter; ``benchmarks=None`` keeps all of them."""

    start: str = "2019-11-01"
    end: str = "2020-11-01"
    group_by: Sequence[str] = ()
    fund_types: Sequence[str] = ("pension", "mutual", LABEL)
    OKS: Sequence[bool] = BOTH
    contribution: Sequence[bool] = BOTH
    participation: Sequence[bool] = BOTH
    categories: Sequence[str] = (ALL,)
    companies: Sequence[str] = (ALL,)
    funds: Sequence[str] = (ALL,)
    benchmarks: Sequence[str] | None = None
    missing: str = "zero"

    def __post_init__(self) -> None:
        unknown = [g for g in self.group_by if g not in GROUPS]
        if unknown:
            raise ValueError(f"cannot group by {unknown}; choose from {GROUPS}")
        if self.missing not in ("zero", "drop"):
            raise ValueError(f"missing must be 'zero' or 'drop', not {self.missing!r}")


def only(df: DataFrame, column: str, wanted: Sequence) -> DataFrame:
    """Rows with a wanted value; no filter at all when ``"ALL"`` is wanted."""
    return df if ALL in wanted else df.filter(F.col(column).isin(*wanted))


def by_product(df: DataFrame, q: Comparison) -> DataFrame:
    """Rows of the wanted types and flags."""
    for column in ("OKS", "contribution", "participation"):
        df = df.filter(F.col(column).isin(*getattr(q, column)))
    return only(df, "fund_type", q.fund_types)


def selected(returns: DataFrame, q: Comparison) -> DataFrame:
    """Rows the comparison is made of, without missing returns."""
    rows = by_product(returns.filter(F.col("date").between(day(q.start), day(q.end))), q)
    rows = only(only(only(rows, "category", q.categories), "company_name", q.companies), "name", q.funds)
    if q.benchmarks is not None:
        rows = rows.filter(F.col("name").isin(*q.benchmarks) | (F.col("fund_type") != LABEL))
    if q.missing == "drop":
        return rows.filter(F.col("monthly_price_change").isNotNull())
    return rows.fillna(0.0, subset=["monthly_price_change"])


def compare(returns: DataFrame, q: Comparison, metric: str = "growth_rate", alias: str | None = None) -> DataFrame:
    """Mean monthly return per group and date, and the metric over each group's dates so far.

    The mean is combined on the map side, so a group of any size reaches the window as one row per
    month. Without groups that is a single series.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {tuple(METRICS)}")
    groups = list(q.group_by)
    means = selected(returns, q).groupBy(*groups, "date").agg(
        F.avg("monthly_price_change").alias("avg_monthly_gain"))
    return means.withColumn(alias or metric, METRICS[metric](F.col("avg_monthly_gain"), groups))


def choices(returns: DataFrame, column: str, q: Comparison | None = None) -> DataFrame:
    """Values to pick from under the filters so far: ``"ALL"``, then a missing value, then ascending.

    Funds also depend on the chosen categories and companies.
    """
    rows = returns if q is None else by_product(returns, q)
    if q is not None and column == "name":
        rows = only(only(rows, "category", q.categories), "company_name", q.companies)
    values = rows.select(F.col(column).alias("choice"), F.lit(1).alias("rank")).distinct()
    everything = returns.sparkSession.range(1).select(F.lit(ALL).alias("choice"), F.lit(0).alias("rank"))
    return everything.union(values).orderBy("rank", F.asc_nulls_first("choice")).select("choice")
