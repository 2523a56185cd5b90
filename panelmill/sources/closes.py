"""Month closes kept up to date by the days that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators.monthly import monthly_close
from panelmill.sources.versioned import VersionedTable, latest

KEYS = ["code", "date"]


class MonthCloses:
    """The closes of ``monthly_close``, stored as cells (code, month) with the day each was taken from.

    New days write only the cells that they change: those of their months whose stored day is not later. So days may
    come in any order and in any split, also one code at a time, and the closes are those of all days together. A day
    that comes again with other values replaces the cell it closed. A cell's older states stay until ``fold``.
    """

    def __init__(self, spark: SparkSession, path: str, kind: T.StructType | str):
        """``kind``: the columns of ``monthly_close`` over the panel, see ``closes_schema``."""
        self.table = VersionedTable(spark, path, kind)

    def add(self, days: DataFrame) -> int:
        """Takes the rows of some days of the panel, and returns the new version; without dated rows, the one before.

        Two rows of a code on a closing date are an error, and nothing is written.
        """
        first, last = days.agg(F.min("date"), F.max("date")).first()
        if first is None:
            return max(self.table.versions(), default=0)
        start, end = first.replace(day=1).isoformat(), last.isoformat()
        stored = self.read(start, end).select(*KEYS, F.col("data_date").alias("_stored"))
        cells = monthly_close(days).join(stored, KEYS, "left")
        return self.table.append(cells.filter(F.col("_stored").isNull() | (F.col("data_date") >= F.col("_stored"))))

    def read(self, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
        """The closes of the months that begin between two days, as of a version."""
        return _newest(self.table.read(start, end, version, with_write=True))

    def fold(self) -> int:
        """Rewrites the months that were written more than once, with each cell's last state."""
        return self.table.fold(_newest)


def closes_schema(panel: DataFrame) -> T.StructType:
    """Columns and types of the closes of a panel."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in monthly_close(panel).schema])


def _newest(cells: DataFrame) -> DataFrame:
    return latest(cells, KEYS, [F.desc("data_date"), F.desc("_write")]).drop("_write")
