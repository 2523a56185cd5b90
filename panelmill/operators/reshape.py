"""Long to wide, wide to long, and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.guards import require


def spread(df: DataFrame, keys: Sequence[str], names: str, values: str, columns: Sequence[str],
           combine=F.max) -> DataFrame:
    """One row per key with one column per listed name.

    The names are given, so it is a single aggregation with a map-side combine. A name that isn't listed
    is an error; a row without a name only makes sure that its key is there.
    """
    known = F.col(names).isNull() | F.col(names).isin(*columns)
    df = require(df, known, F.concat(F.lit(f"unknown {names}: "), F.col(names).cast("string")))
    cells = [combine(F.when(F.col(names) == c, F.col(values))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*cells)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], names: str, values: str) -> DataFrame:
    """One row per key and listed column."""
    return df.unpivot(list(ids), list(columns), names, values)


def columns_with_prefix(df: DataFrame, start: str) -> list[str]:
    return [c for c in df.columns if c.startswith(start)]


def fill_forward(df: DataFrame, column: str, series: Sequence[str], chunk: str, order: str) -> DataFrame:
    """Replace a missing value by the last one before it in the series.

    ``chunk`` cuts a series into consecutive pieces (file splits, years). Each piece is filled on its
    own, and one closing value per piece is carried to the next, so a long series spreads over tasks.
    """
    by_piece = Window.partitionBy(*series, chunk).orderBy(order)
    before = Window.partitionBy(*series).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    here = F.last(column, ignorenulls=True).over(by_piece.rowsBetween(Window.unboundedPreceding, 0))
    closing = (
        df.groupBy(*series, chunk)
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_closing"))
        .select(*series, chunk, F.last("_closing", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        df.withColumn(column, here)
        .join(closing, [*series, chunk], "left")
        .withColumn(column, F.coalesce(column, "_carried"))
        .drop("_carried")
        .select(*df.columns)
    )
