"""Data profile, cleaning rules and the row funnel they leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.dates import span_days
from panelmill.functions.text import prefix

EXCLUDED_CODES = ("FPR",)  # fixed value: the one entry without a category
ANY_LENGTH = 2**31 - 1
RULES = ("excluded_code", "missing_name", "no_price_or_shares", "inactive")


def missing(name: str, kind: T.DataType) -> Column:
    """True where the column is missing; in a column of floating numbers NaN is missing too."""
    test = F.col(name).isNull()
    return test | F.isnan(name) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else test


def zero_or_missing(*columns: str) -> Column:
    """True where any of the measures is zero or missing, NaN included."""
    test = F.lit(False)
    for name in columns:
        test = test | F.col(name).isNull() | (F.col(name) == 0) | F.isnan(F.col(name).cast("double"))
    return test


def positive(name: str) -> Column:
    """True for a measure above zero. NaN, which Spark orders above all numbers, is not."""
    return F.coalesce((F.col(name) > 0) & ~F.isnan(F.col(name).cast("double")), F.lit(False))


def dq_profile(df: DataFrame, columns: Sequence[str] = ("code", "name", "price", "shares", "date", "category"),
               ) -> DataFrame:
    """One row: rows, codes, missing values per column, zero or missing measures, codes with two names.

    Rows are combined per (code, name) on the map side first, so no distinct count ever sees raw rows.
    """
    per_name = df.groupBy("code", "name").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(c, df.schema[c].dataType)).alias(f"null_{c}") for c in columns],
        F.count_if(zero_or_missing("price", "shares")).alias("zero_or_missing"),
    )
    counts = ["rows", *[f"null_{c}" for c in columns], "zero_or_missing"]
    per_code = per_name.groupBy("code").agg(
        F.count("name").alias("names"), *[F.sum(c).alias(c) for c in counts])
    return per_code.agg(
        F.count(F.lit(1)).alias("codes"),
        F.count_if(F.col("names") > 1).alias("codes_with_two_names"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
    ).select("rows", "codes", *counts[1:], "codes_with_two_names")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
        .orderBy(F.desc("count"), *[F.asc_nulls_last(k) for k in keys])
    )


def names_per_code(df: DataFrame) -> DataFrame:
    """Codes that carry more than one name."""
    names = df.select("code", "name").distinct()
    return names.groupBy("code").agg(F.count("name").alias("names")).filter("names > 1")


def first_failed_rule(excluded: Sequence[str]) -> Column:
    """Name of the first rule a row fails on its own; NULL if it passes all of them.

    A missing code, price or share count fails like an excluded one; NaN is missing.
    """
    return (
        F.when(F.col("code").isNull() | F.col("code").isin(*excluded), RULES[0])
        .when(F.col("name").isNull(), RULES[1])
        .when(~(positive("price") & positive("shares")), RULES[2])
    )


def _passing(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return df.filter(first_failed_rule(excluded).isNull())


def active_codes(df: DataFrame) -> DataFrame:
    """Codes with a row on the latest date, one row each, from one pass over the table.

    The code is taken anew, which puts a shuffle between the aggregation and a join: a skewed join is split
    at run time only if both its inputs come straight from a shuffle, and one code may hold most rows.
    """
    latest = df.groupBy("code").agg(F.max("date").alias("_latest"))
    newest = latest.agg(F.max("_latest")).scalar()
    return latest.filter(F.col("_latest") == newest).select(prefix(F.col("code"), ANY_LENGTH).alias("code"))


def clean_panel(df: DataFrame, excluded: Sequence[str] = EXCLUDED_CODES) -> DataFrame:
    """Rows that pass every rule, of codes that still report on the latest date that passes."""
    passing = _passing(df, excluded)
    return passing.join(active_codes(passing), "code", "left_semi").select(*df.columns)


def inactive_rows(df: DataFrame) -> DataFrame:
    """Rows of codes without data on the latest date."""
    return df.join(active_codes(df), "code", "left_anti").select(*df.columns)


def cleaning_funnel(df: DataFrame, excluded: Sequence[str] = EXCLUDED_CODES) -> DataFrame:
    """Per rule: rows it rejects, rows and codes left after it, in rule order (step 0 is the input).

    One pass: rows are counted per code and latest passing date, then per date. Only the last two
    steps, over at most one row per calendar day, are not partitioned.
    """
    rule = first_failed_rule(excluded)
    ok = rule.isNull()
    per_code = df.groupBy("code").agg(
        F.count(F.lit(1)).alias("r0"),
        *[F.count_if(rule.eqNullSafe(F.lit(name))).alias(f"x{i}") for i, name in enumerate(RULES[:3], 1)],
        F.count_if(ok).alias("r3"),
        F.max(F.when(ok, F.col("date"))).alias("latest"),
    ).withColumns({
        "r1": F.col("r0") - F.col("x1"),
        "r2": F.col("r0") - F.col("x1") - F.col("x2"),
    })
    rows = ["r0", "r1", "r2", "r3"]
    per_date = per_code.groupBy("latest").agg(
        *[F.sum(r).alias(r) for r in rows],
        *[F.count_if(F.col(r) > 0).alias(f"c{r[1]}") for r in rows],
    )
    newest = F.max("latest").over(Window.partitionBy())
    current = F.col("latest") == F.col("newest")
    totals = per_date.withColumn("newest", newest).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for r in rows for c in (r, f"c{r[1]}")],
        F.coalesce(F.sum(F.when(current, F.col("r3"))), F.lit(0)).alias("r4"),
        F.coalesce(F.sum(F.when(current, F.col("c3"))), F.lit(0)).alias("c4"),
    )
    steps = [
        F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("rule"),
            (F.lit(0).cast("bigint") if i == 0 else F.col(f"r{i - 1}") - F.col(f"r{i}")).alias("rows_rejected"),
            F.col(f"r{i}").alias("rows_left"), F.col(f"c{i}").alias("codes_left"),
        )
        for i, name in enumerate(("input", *RULES))
    ]
    return totals.select(F.inline(F.array(*steps))).orderBy("step")


def inactive_entities(df: DataFrame) -> DataFrame:
    """Count, dates and span of every code without data on the latest date, most recent first.

    The anti join runs on one row per entity, not on the panel.
    """
    entities = df.groupBy("code", "fund_type", "category").agg(
        F.count(F.lit(1)).alias("count"), F.max("date").alias("latest"), F.min("date").alias("earliest"))
    last_seen = F.max("latest").over(Window.partitionBy("code"))
    return (
        entities.withColumn("last_seen", last_seen)
        .filter(F.col("last_seen") < entities.agg(F.max("latest")).scalar())
        .drop("last_seen")
        .withColumn("length", span_days(F.col("latest"), F.col("earliest")))
        .orderBy(F.desc_nulls_last("latest"), "code")
    )
