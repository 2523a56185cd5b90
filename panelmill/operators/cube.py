"""Comparisons from stored partial sums in place of the returns.

A cuboid holds, for each combination of some group columns and each month, the sum of the returns, how many rows there
are and how many of them have a return. These add up, so a comparison is answered by any cuboid that has the columns it
groups and filters by; the one with the fewest rows is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.operators.benchmark import LABEL
from panelmill.operators.compare import ALL, GROUPS, METRICS, Comparison, by_product, only

FLAGS = ("OKS", "contribution", "participation")
#: The columns of each cuboid besides the flags, which every comparison filters by. The first has all and is always there.
LEVELS = (("fund_type", "category", "company_name", "name"), ("fund_type", "category", "company_name"),
          ("fund_type", "category"), ("fund_type", "company_name"), ("fund_type",))
SUMS = ("gain_sum", "rows", "known")
LIST = "levels STRING, path STRING, rows BIGINT"


def partials(returns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The sums by the columns and ``date``, combined on the map side."""
    gain = F.col("monthly_price_change")
    return returns.groupBy(*columns, "date").agg(
        F.sum(F.coalesce(gain, F.lit(0.0))).alias("gain_sum"), F.count(F.lit(1)).alias("rows"), F.count(gain).alias("known"))


def coarser(cuboid: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cuboid.groupBy(*columns, "date").agg(*(F.sum(s).alias(s) for s in SUMS))


def write_cube(returns: DataFrame, path: str, levels: Sequence[Sequence[str]] = LEVELS) -> None:
    """Writes a cuboid for each level to a folder below ``path``, and the list of them with their row counts.

    The returns are read once; every other cuboid is summed up from the first. The list is written last.
    """
    spark, path = returns.sparkSession, path.rstrip("/")
    every = [c for c in GROUPS if c not in FLAGS]
    if not levels or set(levels[0]) != set(every):
        raise ValueError(f"the first level must have all of {every}")
    written = []
    for i, level in enumerate(levels):
        columns, at = [*level, *FLAGS], f"{path}/cuboid-{i}"
        rows = partials(returns, columns) if i == 0 else coarser(spark.read.parquet(f"{path}/cuboid-0"), columns)
        rows.hint("rebalance").sortWithinPartitions("date").write.parquet(at)
        written.append((",".join(level), at, spark.read.parquet(at).count()))
    spark.createDataFrame(written, LIST).coalesce(1).write.parquet(f"{path}/list")


def columns_of(q: Comparison) -> set[str]:
    """Columns that a cuboid must have for the comparison, flags left out: those it groups by or filters by."""
    filters = {"fund_type": q.fund_types, "category": q.categories, "company_name": q.companies, "name": q.funds}
    needed = {c for c, wanted in filters.items() if ALL not in wanted} | set(q.group_by)
    return (needed | ({"name", "fund_type"} if q.benchmarks is not None else set())) - set(FLAGS)


def best_cuboid(spark: SparkSession, path: str, q: Comparison) -> DataFrame:
    """The smallest cuboid with the comparison's columns; ties go to the first."""
    listed = spark.read.schema(LIST).parquet(f"{path.rstrip('/')}/list").collect()  # one row for each level
    fit = [(r.rows, r.path) for r in listed if columns_of(q) <= set(r.levels.split(","))]
    return spark.read.parquet(min(fit)[1])


def compare_from_cube(spark: SparkSession, path: str, q: Comparison, metric: str = "growth_rate", alias: str | None = None) -> DataFrame:
    """What ``compare.compare`` gives over the returns that the cube was written from, up to the order of additions."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {tuple(METRICS)}")
    rows = best_cuboid(spark, path, q).filter(F.col("date").between(day(q.start), day(q.end)))
    rows = by_product(rows, q)
    rows = only(only(only(rows, "category", q.categories), "company_name", q.companies), "name", q.funds)
    if q.benchmarks is not None:
        rows = rows.filter(F.col("name").isin(*q.benchmarks) | (F.col("fund_type") != LABEL))
    counted = "known" if q.missing == "drop" else "rows"
    groups = list(q.group_by)
    means = rows.groupBy(*groups, "date").agg(F.sum("gain_sum").alias("_sum"), F.sum(counted).alias("_n")).filter("_n > 0")
    means = means.select(*groups, "date", (F.col("_sum") / F.col("_n")).alias("avg_monthly_gain"))
    return means.withColumn(alias or metric, METRICS[metric](F.col("avg_monthly_gain"), groups))
