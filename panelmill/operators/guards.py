"""Checks that no later projection can remove, because rows are filtered by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, test: Column, message: Column) -> DataFrame:
    """``df`` unchanged; a row that fails the test is an error."""
    return df.filter(F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def single(df: DataFrame, count: str, what: str, *keys: str) -> DataFrame:
    """``df`` without the column ``count``, which must be 1 (or missing, in rows that matched nothing)."""
    where = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    ok = F.col(count).isNull() | (F.col(count) <= 1)
    return require(df, ok, F.concat(F.lit(f"more than one {what} for ({', '.join(keys)}) = "), where)).drop(count)
