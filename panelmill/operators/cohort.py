"""Index of an early cohort and its performance against benchmarks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.functions.windows import indexed, previous, sequence_number
from panelmill.operators.guards import require

IDENTITY = ("fund_type", "category", "company_name", "company_code", "name", "code")
# Benchmarks compared with, and the class labels.
COMPARED = {"usd": "b_usd", "gold": "b_gold", "xu100": "b_xu100"}
EXCELLENT, LOSS, BEHIND = "excellent profit", "loss", "profit but less than usd"


def first_dates(panel: DataFrame) -> DataFrame:
    """Earliest date per code; of a cohort's rows, it checks that they all begin where the cohort does."""
    return panel.groupBy("code").agg(F.min("date").alias("earliest"))


def cohort_index(panel: DataFrame, seen_before: str = "2018-02-05", after: str = "2018-03-15") -> DataFrame:
    """Rows after a date of codes that existed before another, indexed to each code's first such row.

    Membership is the minimum date of the code's own window, so the panel is shuffled by code once.
    """
    joined_at = F.min("date").over(Window.partitionBy("code"))
    members = panel.withColumn("_joined", joined_at).filter(
        (F.col("_joined") < day(seen_before)) & (F.col("date") > day(after)))
    return members.drop("_joined").withColumns({
        "counter": sequence_number(["code"]),
        "price_indexed": indexed(F.col("price"), ["code"]),
    })


def relative_performance(index: DataFrame, first: str = "2018-03-30", last: str = "2020-09-30",
                         compared: Mapping[str, str] = COMPARED) -> DataFrame:
    """Index on the later of two dates, with each benchmark's growth since the earlier one."""
    anchors = index.filter(F.col("date").isin(day(first), day(last)))
    before = {"prv_price": previous(F.col("price_indexed"), IDENTITY)}
    before |= {f"prv_{name}": previous(F.col(column), IDENTITY) for name, column in compared.items()}
    rows = anchors.withColumns(before).filter(F.col("date") == day(last))
    growth = {f"chng_{name}": F.try_divide(F.col(column), F.col(f"prv_{name}")) for name, column in compared.items()}
    measures = [m for name, column in compared.items() for m in (column, f"prv_{name}", f"chng_{name}")]
    return rows.withColumns(growth).select(
        "counter", "date", "year", "month", *IDENTITY, "prv_price", "price", "price_indexed",
        "total_value", "shares", *measures)


def profit_class(performance: DataFrame, against: str = "chng_usd") -> DataFrame:
    """Adds the class of each entity; none where the comparison is undefined."""
    index, benchmark = F.col("price_indexed"), F.col(against)
    return performance.withColumn(
        "profit", F.when(index > benchmark, EXCELLENT).when(index < 1, LOSS).when(index <= benchmark, BEHIND))


def profit_counts(classified: DataFrame) -> DataFrame:
    """Entities per category and class."""
    return (
        classified.filter(F.col("profit").isNotNull())
        .groupBy("category", "profit").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.asc_nulls_last("category"), "profit")
    )


def best_k(performance: DataFrame, k: int = 50, skip: int = 0,
           columns: Sequence[str] = ("fund_type", "category", "company_code", "code", "price_indexed")) -> DataFrame:
    """Entities with the highest index after the first ``skip``; ties go by code."""
    ranked = performance.select(*columns).orderBy(F.desc_nulls_last("price_indexed"), "code")
    return (ranked.offset(skip) if skip else ranked).limit(k)


def series_of(index: DataFrame, best: DataFrame, most: int = 1000) -> DataFrame:
    """Whole index series of the ranked codes. More than ``most`` codes are an error, so they can be broadcast."""
    codes = best.select("code").distinct().limit(most + 1)
    counted = codes.withColumn("_codes", F.count(F.lit(1)).over(Window.partitionBy()))
    checked = require(counted, F.col("_codes") <= most, F.lit(f"more than {most} codes to broadcast"))
    return index.join(F.broadcast(checked.select("code")), "code", "left_semi")
