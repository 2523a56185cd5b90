"""Broadcast decisions from measured table sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A parquet column takes about this many times its file size in memory, and a row at least its declared width.
EXPANSION = 4


def size_in_bytes(table: DataFrame) -> int | None:
    """Bytes Spark will read for a table scan; None in a session that does not show its plans."""
    if not hasattr(table, "_jdf"):
        return None
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own limit in bytes, however the setting is written; negative if broadcasts are off."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def broadcast_if_small(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is estimated below Spark's own limit.

    ``df`` has one row per row of the table ``source``; its size is the table's, unpacked, times how much
    wider its rows are. Spark multiplies the sizes of joined tables, so it takes a dimension that was
    itself joined from small tables for a huge one, and might broadcast the other side. Above the limit
    nothing is marked and the join is shuffled.
    """
    size = size_in_bytes(source)
    if size is None:
        return df
    wider = max(1.0, df._jdf.schema().defaultSize() / max(1, source._jdf.schema().defaultSize()))
    return F.broadcast(df) if size * EXPANSION * wider <= broadcast_limit(df.sparkSession) else df
