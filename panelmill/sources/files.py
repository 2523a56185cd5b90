"""Sheets, dimensions, series and staged tables on any file system Spark reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill import schema
from panelmill.functions.dates import day, parse_date
from panelmill.operators.guards import single

Paths = str | Sequence[str]
YEAR_FOLDER = "panel_year"
SHEET_FOLDER = "sheet_number"
BAD_LINE = "_bad_line"


def _scan(spark: SparkSession, paths: Paths, kind: T.StructType, file_format: str, **options: str) -> DataFrame:
    checked = {"header": "true", "enforceSchema": "false", "encoding": "UTF-8"} if file_format == "csv" else {}
    reader = spark.read.format(file_format).schema(kind).options(**(checked | options))
    return reader.load(paths if isinstance(paths, str) else list(paths))


def _union_by_type(spark: SparkSession, paths: Mapping[str, Paths], kind: T.StructType, file_format: str,
                   **options: str) -> DataFrame:
    scans = [_scan(spark, p, kind, file_format, **options).withColumn("fund_type", F.lit(t))
             for t, p in paths.items()]
    return reduce(DataFrame.unionByName, scans)


def unreadable_lines(spark: SparkSession, paths: Mapping[str, Paths], kind: T.StructType, **options: str) -> DataFrame:
    """Lines of CSV sheets with a cell that isn't of its declared type, with the fund type they belong to.

    The readers give NULL for such cells; count these lines to see how many, or read with ``mode="FAILFAST"``.
    """
    marked = T.StructType([*kind, T.StructField(BAD_LINE, T.StringType())])
    rows = _union_by_type(spark, paths, marked, "csv", columnNameOfCorruptRecord=BAD_LINE, enforceSchema="true", **options)
    return rows.filter(F.col(BAD_LINE).isNotNull())


def reject_counts(spark: SparkSession, paths: Mapping[str, Paths], kind: T.StructType, **options: str) -> DataFrame:
    """How many lines of each fund type's sheets are unreadable.

    Only columns in use are looked at by the CSV parser, so all of them go into the first count's key.
    """
    bad = unreadable_lines(spark, paths, kind, **options)
    per_value = bad.groupBy("fund_type", F.xxhash64(*bad.columns)).agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("fund_type").agg(F.sum("n").alias("lines"))


def read_prices(spark: SparkSession, paths: Mapping[str, Paths], file_format: str = "csv", **options: str) -> DataFrame:
    """Price sheets of each fund type: one scan per type over all its files, columns renamed."""
    sheets = _union_by_type(spark, paths, schema.PRICE_SHEET, file_format, **options)
    return sheets.withColumnsRenamed(schema.PRICE_NAMES)


def read_allocations(spark: SparkSession, paths: Mapping[str, Paths], file_format: str = "csv",
                     **options: str) -> DataFrame:
    """Allocation sheets of each fund type, columns renamed, without the name the prices carry."""
    sheets = _union_by_type(spark, paths, schema.ALLOCATION_SHEET, file_format, **options)
    return sheets.withColumnsRenamed(schema.ALLOCATION_KEYS | schema.ALLOCATION_NAMES).drop("name")


def read_categories(spark: SparkSession, headings: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Category of each code from comparison reports: path to its (code, category) headings.

    The reports have more columns than these two, so the headings are looked up in the file. A code that two
    reports or lines list stays twice here; ``consolidate_daily`` refuses it.
    """
    reports = [
        spark.read.option("header", True).csv(path).select(F.col(code).alias("code"), F.col(category).alias("category"))
        for path, (code, category) in headings.items()]
    return reduce(DataFrame.unionByName, reports)


def read_companies(spark: SparkSession, path: Paths) -> DataFrame:
    return _scan(spark, path, schema.COMPANIES, "csv")


def read_series(spark: SparkSession, path: Paths, name: str, layout: str,
                columns: tuple[str | int, str | int] = (1, 2), sep: str = ",") -> DataFrame:
    """One benchmark series in long form, from the date and value columns given by heading or place.

    Rows without a readable date and value are left out. That covers the footers of such files, so
    no row position is needed.
    """
    sheet = spark.read.options(header="true", sep=sep, encoding="UTF-8").csv(path)
    date, value = (F.col(f"`{c if isinstance(c, str) else sheet.columns[c - 1]}`") for c in columns)
    rows = sheet.select(
        parse_date(date, layout).alias("date"), F.lit(name).alias("name"), value.try_cast("double").alias("price"))
    return rows.filter(F.col("date").isNotNull() & F.col("price").isNotNull())


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet table. With partition columns, rows are rebalanced so that a large partition is split
    over several files and a small one is not scattered."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_daily_panel(df: DataFrame, path: str, kind: T.StructType = schema.DAILY_PANEL) -> None:
    """Daily panel in folders by year, which ``read_daily_panel`` skips by date. Declared columns get their type."""
    typed = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in kind if f.name in df.columns})
    write_stage(typed.withColumn(YEAR_FOLDER, F.year("date")), path, [YEAR_FOLDER])


def read_daily_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                     kind: T.StructType | None = schema.DAILY_PANEL) -> DataFrame:
    """The staged daily panel between two dates (both included), with the columns that were written.

    Only the folders of those years are read. The schema is declared; ``None`` takes it from the files, for
    panels with other columns. Rows without a date are read only if no date is given.
    """
    reader = spark.read if kind is None else spark.read.schema(T.StructType([*kind, T.StructField(YEAR_FOLDER, T.IntegerType())]))
    rows = reader.parquet(path)
    if start is not None:
        rows = rows.filter((F.col(YEAR_FOLDER) >= int(start[:4])) & (F.col("date") >= day(start)))
    if end is not None:
        rows = rows.filter((F.col(YEAR_FOLDER) <= int(end[:4])) & (F.col("date") <= day(end)))
    return rows.drop(YEAR_FOLDER)


def write_bucketed_panel(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Panel as a table bucketed by code: windows and joins by code then read it without a shuffle.

    One code goes to one bucket, so the panel must be unique per code and date; a repeated key is an error.
    ``path`` is the table's location; without it, the session's warehouse is used.
    """
    rows = df.repartition(buckets, "code").withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("code", "date")))
    writer = single(rows, "_rows", "row", "code", "date").write.mode("overwrite").bucketBy(buckets, "code").sortBy("code", "date")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_csv_by(df: DataFrame, path: str, by: str, kinds: Sequence[str], columns: Sequence[Column]) -> dict[str, str]:
    """A folder of CSV files with headings, holding ``columns``, for each of the values ``kinds`` of the column ``by``.

    One pass: every task writes a file for each kind it holds. Rows of other kinds are left out; a kind without rows
    gets a file of headings. The writer needs a task's rows in order of their kind, so they are sorted here, before
    ``columns`` adds empty ones.
    """
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col(by))
    ordered = df.withColumn(SHEET_FOLDER, number).filter(F.col(SHEET_FOLDER) > 0).sortWithinPartitions(SHEET_FOLDER)
    sheets = ordered.select(*columns, SHEET_FOLDER)
    options = {"header": "true", "encoding": "UTF-8"}
    sheets.write.mode("overwrite").partitionBy(SHEET_FOLDER).options(**options).csv(path)
    paths = {kind: f"{path}/{SHEET_FOLDER}={i}" for i, kind in enumerate(kinds, 1)}
    spark = df.sparkSession
    for folder in paths.values():
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            write_csv(spark.createDataFrame([], sheets.drop(SHEET_FOLDER).schema), folder)
    return paths
