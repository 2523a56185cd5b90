"""Running measures of one long series by segments, so that a series is spread over many tasks.

A segment of a series is summed up in one row: how many rows, first and last value, number, mean and squared
deviations of the gains, their product. These combine associatively. The rows before a segment reach it as one carried row,
and windows run inside segments only. Results are those of ``panelmill.functions.windows``, which give a series to one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.guards import require

SEGMENT = "_segment"


def running(df: DataFrame, by: Sequence[str], segment: Column, order: str = "date", number: str | None = None,
            previous: Mapping[str, str] | None = None, indexed: Mapping[str, str] | None = None,
            growth: Mapping[str, str] | None = None, risk: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with running measures over the rows of each ``by``, in the order of ``order``.

    ``segment`` is any expression that never falls as ``order`` rises, such as the year of a date; its cut changes
    no result. ``number`` names a column for 1, 2, 3, ...; the mappings give new columns and the values they are made from:
    the value of the row before; the value relative to the first row; the product of all ``1 + value`` so far; the population
    standard deviation of all values so far. A missing value is skipped by the last two and kept by the first two.
    A row without ``order``, two rows in one place, and segments that overlap are errors.
    """
    previous, indexed, growth, risk = (dict(m or {}) for m in (previous, indexed, growth, risk))
    keys = [*by, SEGMENT]
    rows = require(df, F.col(order).isNotNull(), F.lit(f"a row without {order}")).withColumn(SEGMENT, segment)
    carried = _carried(rows, by, order, previous, indexed, growth, risk).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    # no segment is lost: each one has its carried row
    rows = rows.join(carried, same, "left").drop(*(f"_k_{k}" for k in keys))
    inside = Window.partitionBy(*keys).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(inside)
    rows = rows.withColumns({"_place": place, "_before": F.lag(order).over(inside)})
    rows = require(rows, F.col("_before").isNull() | (F.col("_before") < F.col(order)), F.concat(
        F.lit(f"two rows at {order} "), F.col(order).cast("string")))
    out = {}
    if number:
        out[number] = (F.col("_place") + F.col("_n")).cast("int")
    for name, value in previous.items():
        out[name] = F.when(F.col("_place") == 1, F.col(f"_last_{name}")).otherwise(F.lag(value).over(inside))
    for name, value in indexed.items():
        out[name] = F.try_divide(F.col(value), F.col(f"_first_{name}"))
    for name, value in growth.items():
        own, before = F.product(F.col(value) + 1).over(so_far), F.col(f"_product_{name}")
        out[name] = F.coalesce(own * before, own, before)
    for name, value in risk.items():
        count = F.count(value).over(so_far).cast("double")
        out[name] = _deviation(
            F.col(f"_count_{name}"), F.col(f"_mean_{name}"), F.col(f"_squares_{name}"),
            count, F.avg(value).over(so_far), F.var_pop(value).over(so_far) * count)
    return rows.withColumns(out).select(*df.columns, *out)


def _carried(rows: DataFrame, by: Sequence[str], order: str, previous: Mapping[str, str], indexed: Mapping[str, str],
             growth: Mapping[str, str], risk: Mapping[str, str]) -> DataFrame:
    """One row per segment: what all segments of its series before it come to."""
    sums = [F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")]
    sums += [F.max_by(v, order).alias(f"last_{n}") for n, v in previous.items()]
    sums += [F.min_by(v, order).alias(f"first_{n}") for n, v in indexed.items()]
    sums += [F.product(F.col(v) + 1).alias(f"product_{n}") for n, v in growth.items()]
    for name, value in risk.items():
        sums += [F.count(value).cast("double").alias(f"count_{name}"), F.avg(value).alias(f"mean_{name}"), F.var_pop(value).alias(f"var_{name}")]
    parts = rows.groupBy(*by, SEGMENT).agg(*sums)
    series = Window.partitionBy(*by).orderBy(F.col(SEGMENT).asc_nulls_last())
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("_below", F.max("high").over(before))
    parts = require(parts, F.col("_below").isNull() | (F.col("_below") < F.col("low")), F.concat(
        F.lit(f"segments overlap at {order} "), F.col("low").cast("string")))
    out = {"_n": F.coalesce(F.sum("n").over(before), F.lit(0))}
    out |= {f"_last_{n}": F.lag(f"last_{n}").over(series) for n in previous}
    out |= {f"_first_{n}": F.first(f"first_{n}").over(whole) for n in indexed}
    out |= {f"_product_{n}": F.product(f"product_{n}").over(before) for n in growth}
    pivots = {f"_pivot_{n}": F.first(f"mean_{n}", ignorenulls=True).over(whole) for n in risk}
    parts = parts.withColumns(pivots) if pivots else parts
    for name in risk:
        count, off = F.col(f"count_{name}"), F.col(f"mean_{name}") - F.col(f"_pivot_{name}")
        n = F.coalesce(F.sum(count).over(before), F.lit(0.0))
        total = F.sum(count * off).over(before)
        # deviations from the pivot, then moved to the mean: exact enough as the pivot is a mean itself
        squares = F.sum(F.col(f"var_{name}") * count + count * off * off).over(before)
        out[f"_count_{name}"] = n
        out[f"_mean_{name}"] = F.col(f"_pivot_{name}") + F.try_divide(total, n)
        out[f"_squares_{name}"] = F.greatest(squares - F.try_divide(total * total, n), F.lit(0.0))
    return parts.withColumns(out).select(*by, SEGMENT, *out)


def _deviation(n_a: Column, mean_a: Column, squares_a: Column, n_b: Column, mean_b: Column, squares_b: Column) -> Column:
    """Population standard deviation of two groups together."""
    n, apart = n_a + n_b, mean_b - mean_a
    both = (squares_a + squares_b + apart * apart * n_a * n_b / n) / n
    only_b = F.sqrt(squares_b / F.when(n_b > 0, n_b))
    only_a = F.sqrt(squares_a / F.when(n_a > 0, n_a))
    return F.when((n_a > 0) & (n_b > 0), F.sqrt(both)).when(n_b > 0, only_b).otherwise(only_a)
