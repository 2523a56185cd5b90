"""Queries over text files: the given tables written as sheets, series and crosstabs, and read back by the readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill import schema
from panelmill.functions.dates import DAY_MONTH_YEAR
from panelmill.operators.consolidate import consolidate_daily
from panelmill.plans import quality_queries as qq
from panelmill.plans.benchmark_queries import REGIONS
from panelmill.plans.common import Entry, with_views
from panelmill.plans.views import (
    ASSETS, BENCHMARK_DAILY_SQL, BENCHMARK_MONTHS_SQL, RAW_QUOTES_SQL, SERIES, allocations, benchmark_daily, benchmark_months,
    entities, fund_daily, raw_quotes,
)
from panelmill.sources import crosstab, files
from panelmill.sources.shared import new_path

REPORT = ("Fund Code", "Umbrella Fund Type")
SHEETS = ("mutual", "pension")
ASSET_HEADINGS = dict(zip((f"p_{a}" for a in ASSETS), schema.ALLOCATION_NAMES))


def _sheets(df: DataFrame, by: str, kinds: Sequence[str], name: str, columns: Sequence[Column]) -> dict[str, str]:
    """A folder of CSV files with headings for each kind, also for one without rows. ``df`` is computed once."""
    return files.write_csv_by(df, new_path(df.sparkSession, name), by, kinds, columns)


def _price_columns(**given: Column) -> list[Column]:
    """The columns of a price sheet in order, empty where none is given."""
    return [given.get(name, F.lit(None).cast("string")).alias(heading) for heading, name in schema.PRICE_NAMES.items()]


def _consolidate_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Prices, allocations and the category report written as CSV sheets, read back and consolidated."""
    quotes = _price_columns(**{c: F.col(c) for c in schema.PRICE_NAMES.values()})
    held = {heading: F.col(c) for c, heading in ASSET_HEADINGS.items()}
    shares = [F.col("date").alias("Tarih"), F.col("code").alias("Fon Kodu"), F.lit(None).cast("string").alias("Fon Adı"),
              *[held.get(h, F.lit(None).cast("double")).alias(h) for h in schema.ALLOCATION_NAMES]]
    report = new_path(spark, "report")
    files.write_csv(entities(spark, d).select(F.col("category").alias(REPORT[1]), F.col("name").alias("Fund Name"), F.col("code").alias(REPORT[0])), report)

    prices = files.read_prices(spark, _sheets(fund_daily(spark, d), "fund_type", REGIONS, "prices", quotes))
    read = files.read_allocations(spark, _sheets(allocations(spark, d), "fund_type", REGIONS, "allocations", shares))
    names = {schema.ALLOCATION_NAMES[heading]: c for c, heading in ASSET_HEADINGS.items()}
    return consolidate_daily(
        prices.withColumn("people", F.col("people").cast("long")),
        read.select("date", "code", "fund_type", *names).withColumnsRenamed(names),
        files.read_categories(spark, {report: REPORT}))


def _refused_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as sheets whose missing prices are a word, and how many lines of each sheet type that makes unreadable."""
    cells = {c: F.col(c) for c in ("date", "code", "name", "shares")}
    price = F.coalesce(F.col("price").cast("string"), F.lit("n/a"))
    kind = F.when(F.col("code").cast("long") % 2 == 0, SHEETS[0]).otherwise(SHEETS[1])
    sheets = _sheets(raw_quotes(spark, d).withColumn("fund_type", kind), "fund_type", SHEETS, "quotes", _price_columns(price=price, **cells))
    return files.reject_counts(spark, sheets, schema.PRICE_SHEET)


def _series_files(spark: SparkSession, d: str) -> DataFrame:
    """Each daily series as a file of its own with notes under it; date and value are read by place."""
    daily = benchmark_daily(spark, d).select(
        "name", F.date_format("date", DAY_MONTH_YEAR).alias("Tarih"), F.lit("x").alias("Birim"), F.col("price").cast("string").alias("Fiyat"))
    notes = daily.select("name").distinct().select("name", F.lit("Notlar:").alias("Tarih"), F.lit("x").alias("Birim"), F.lit("1").alias("Fiyat"))
    paths = _sheets(daily.unionAll(notes), "name", SERIES, "series", [F.col(c) for c in ("Tarih", "Birim", "Fiyat")])
    return reduce(DataFrame.unionByName, [files.read_series(spark, path, name, DAY_MONTH_YEAR, (1, 3)) for name, path in paths.items()])


def _crosstab_files(spark: SparkSession, d: str) -> DataFrame:
    """Each monthly series as a crosstab file: a heading line, and the year only on its first line."""
    months = benchmark_months(spark, d)
    first = F.row_number().over(Window.partitionBy("name", F.year("date")).orderBy("date")) == 1
    empty = F.lit(None).cast("string")
    lines = months.select(
        "name", "date", empty.alias("label"), F.when(first, F.year("date").cast("string")).alias("year"),
        F.date_format("date", "MM-MMMM").alias("month"), F.col("price").cast("string").alias("value"))
    heading = months.select("name").distinct().select(
        "name", F.lit(None).cast("date").alias("date"), F.lit("Satırlar").alias("label"), empty.alias("year"), empty.alias("month"), F.lit("Türkiye-TR").alias("value"))
    cells = [F.col(c) if c in ("label", "year", "month", "value") else empty.alias(c) for c in schema.CROSSTAB.names]
    path = new_path(spark, "crosstabs")
    # a file is in the order of its rows, so each series is written by one task: it has a row per month
    ordered = lines.unionAll(heading).repartition("name").sortWithinPartitions("name", "date")
    ordered.select("name", *cells).write.partitionBy("name").options(sep="|", encoding="UTF-8").csv(path)
    rows = crosstab.read_crosstab(spark, path).withColumn("name", F.regexp_extract("file", "/name=([^/]+)/", 1))
    return crosstab.crosstab_series(rows, ["name", "file"]).select("name", "date", "price")


QUERIES = {
    "consolidate_from_sheets": Entry(_consolidate_sheets, qq.QUERIES["consolidate_daily"].sql),
    "sheet_lines_refused": Entry(_refused_lines, with_views(
        f"""SELECT CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN '{SHEETS[0]}' ELSE '{SHEETS[1]}' END AS fund_type,
          CAST(COUNT(*) AS BIGINT) AS lines FROM raw_quotes WHERE price IS NULL GROUP BY 1""", RAW_QUOTES_SQL)),
    "benchmark_from_series_files": Entry(_series_files, with_views(
        f"SELECT * FROM benchmark_daily WHERE price IS NOT NULL AND name IN {SERIES}", BENCHMARK_DAILY_SQL)),
    "benchmark_from_crosstab_files": Entry(_crosstab_files, with_views(
        "SELECT name, date, price FROM benchmark_months", BENCHMARK_MONTHS_SQL)),
}
