"""Profiles and rank summaries per day that merge over any range of days without the raw rows.

A day's distinct codes are a HyperLogLog sketch, its values a KLL sketch; both have a fixed size, combine on the map side
and merge in any order. Estimates depend on the order of merging within the stated errors, so they are not repeatable to
the last digit; counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import day
from panelmill.operators.quality import missing, zero_or_missing

LG_K, K = 14, 1000
PROFILED = ("code", "name", "price", "shares", "category")


def distinct_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error of a distinct count after a merge; 99.7 % of estimates are within three standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """Error of one value's rank, as a share of all rows, that 99 % of estimates keep."""
    return 2.296 / k ** 0.9021


def _number(df: DataFrame, value: str) -> Column:
    """The value as a double; NaN is missing, and a sketch leaves missing values out."""
    return F.when(~missing(value, df.schema[value].dataType), F.col(value).cast("double"))


def day_profiles(df: DataFrame, value: str = "price", by: Sequence[str] = (), columns: Sequence[str] = PROFILED,
                 lg_k: int = LG_K, k: int = K) -> DataFrame:
    """One row per date (and ``by``): rows, missing values per column, zero or missing measures, and the two sketches.

    Rows without a date are one group of their own, which no range of days takes in. A date without any code or value
    has an empty sketch.
    """
    return df.withColumn("_value", _number(df, value)).groupBy("date", *by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(c, df.schema[c].dataType)).alias(f"null_{c}") for c in columns],
        F.count_if(zero_or_missing("price", "shares")).alias("zero_or_missing"),
        F.hll_sketch_agg("code", lg_k).alias("codes_sketch"),
        F.count("_value").alias("values"),
        F.kll_sketch_agg_double("_value", k).alias("values_sketch"))


def merged_profile(profiles: DataFrame, start: str, end: str, by: Sequence[str] = (),
                   quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row (per ``by``) for the days from ``start`` to ``end``, both included: exact counts, the estimated number of
    codes, and the estimated values at the quantiles (NULL without values)."""
    days = profiles.filter((F.col("date") >= day(start)) & (F.col("date") <= day(end)))
    counts = [c for c in profiles.columns if c in ("rows", "zero_or_missing", "values") or c.startswith("null_")]
    merged = days.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.hll_union_agg("codes_sketch").alias("_codes"),
        F.kll_merge_agg_double(F.when(F.col("values") > 0, F.col("values_sketch"))).alias("_values"))
    return merged.select(
        *by, *counts, F.coalesce(F.hll_sketch_estimate("_codes"), F.lit(0)).alias("codes"),
        _at("_values", quantiles).alias("quantiles"))


def _at(sketch: str, quantiles: Sequence[float]) -> Column:
    return F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double(
        sketch, F.array(*[F.lit(float(q)) for q in quantiles])))


def rank_summaries(df: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """Per group: number of values and their KLL sketch, from one pass. Groups without a value are left out."""
    rows = df.withColumn("_value", _number(df, value)).filter(F.col("_value").isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("values"), F.kll_sketch_agg_double("_value", k).alias("values_sketch"))


def merged_summaries(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summaries of coarser groups, from those of finer ones."""
    return summaries.groupBy(*by).agg(
        F.sum("values").alias("values"), F.kll_merge_agg_double("values_sketch").alias("values_sketch"))


def quantile_edges(summaries: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Per group: number of values and ``bins + 1`` ascending edges, the first and last being least and greatest value."""
    return summaries.select(*by, "values", _at("values_sketch", [i / bins for i in range(bins + 1)]).alias("edges"))


def quantile_histogram(df: DataFrame, value: str, edges: DataFrame, facet: str) -> DataFrame:
    """Exact rows per facet and bin of ``edges``, with the bin's limits; empty bins are left out.

    A bin holds the values above its lower edge up to its upper one, the first also its lower edge. Where a value is so
    frequent that edges are equal, the first of these bins holds it. The edges (one row a facet) are joined; Spark
    decides how from their size, and values are counted per facet and bin on the map side.
    """
    rows = df.select(F.col(facet), _number(df, value).alias("_value")).filter(F.col("_value").isNotNull())
    placed = rows.join(edges.select(F.col(facet).alias("_facet"), "edges"), F.col(facet).eqNullSafe(F.col("_facet")))
    upper = F.slice("edges", F.lit(2), F.size("edges") - 1)
    below = F.size(F.filter(upper, lambda e: e < F.col("_value")))
    number = F.least(below, F.size("edges") - 2).alias("bin")
    counts = placed.select(facet, number, "edges").groupBy(facet, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.any_value("edges").alias("edges"))
    return counts.select(
        facet, "bin", F.get("edges", F.col("bin")).alias("low"), F.get("edges", F.col("bin") + 1).alias("high"), "count",
    ).orderBy(F.asc_nulls_last(facet), "bin")


def edge_ranks(df: DataFrame, value: str, edges: DataFrame, facet: str, count: int) -> DataFrame:
    """Per facet and edge 0..count-1: values of the facet, values below the edge and values up to it, all exact."""
    rows = df.select(F.col(facet).alias("_facet"), _number(df, value).alias("_value")).filter(F.col("_value").isNotNull())
    placed = rows.join(edges.select(facet, "edges"), F.col(facet).eqNullSafe(F.col("_facet")))
    at = [F.get("edges", F.lit(i)) for i in range(count)]
    counted = placed.groupBy(facet).agg(
        F.count(F.lit(1)).alias("values"),
        *[F.count_if(F.col("_value") < e).alias(f"below_{i}") for i, e in enumerate(at)],
        *[F.count_if(F.col("_value") <= e).alias(f"up_to_{i}") for i, e in enumerate(at)])
    ranks = [F.struct(F.lit(i).alias("edge"), F.col(f"below_{i}").alias("below"), F.col(f"up_to_{i}").alias("up_to"))
             for i in range(count)]
    return counted.select(facet, "values", F.inline(F.array(*ranks)))


def within(rank: Column, error: float, below: str = "below", up_to: str = "up_to") -> Column:
    """True where a value with ``below`` of the ``values`` under it and ``up_to`` up to it stands for the rank, but for the error."""
    n = F.col("values")
    return (F.col(below) <= (rank + error) * n) & (F.col(up_to) >= (rank - error) * n)
