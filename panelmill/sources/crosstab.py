"""Price index in crosstab layout: the year stands only on the first row of each block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.dates import YEAR_MONTH, parse_date
from panelmill.operators.reshape import fill_forward
from panelmill.schema import CROSSTAB


def read_crosstab(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pipe-separated crosstab with their place in the file.

    Place is the file, the split's offset in it and the row's rank within the split, so even a file
    of many splits needs no single task to number its lines.
    """
    rows = spark.read.schema(CROSSTAB).option("sep", "|").option("encoding", "UTF-8").csv(path)
    return rows.select(
        "year", "month", "value",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"))


def crosstab_series(rows: DataFrame, series: Sequence[str] = ("file",), chunk: str = "split",
                    order: str = "line") -> DataFrame:
    """Monthly values: year carried down, ``MM-Name`` read as the month, other rows dropped."""
    month = F.split_part(F.col("month"), F.lit("-"), F.lit(1))
    date = parse_date(F.concat_ws("-", F.col("year"), month), YEAR_MONTH)
    return (
        fill_forward(rows, "year", series, chunk, order)
        .select(*series, date.alias("date"), F.col("value").try_cast("double").alias("price"))
        .filter(F.col("date").isNotNull())
    )


def cpi_crosstab(spark: SparkSession, path: str, name: str = "b_tufe") -> DataFrame:
    """The crosstab file as one benchmark series."""
    return crosstab_series(read_crosstab(spark, path)).select("date", F.lit(name).alias("name"), "price")
