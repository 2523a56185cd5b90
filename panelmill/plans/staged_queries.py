"""Queries over tables that are written first: versioned days, month closes kept up to date, picker indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill import schema
from panelmill.functions.numeric import simple_return
from panelmill.operators import benchmark, compare, cube, pickers, rules, sketches
from panelmill.operators.consolidate import consolidate_daily
from panelmill.operators.segments import running
from panelmill.plans import benchmark_queries as bq
from panelmill.plans import quality_queries as qq
from panelmill.plans.benchmark_queries import REGIONS, TYPES, _choices_sql, _pickable
from panelmill.plans.common import Entry, rounded, with_views
from panelmill.plans.views import (
    FUND_DAILY_SQL, FUND_MONTHLY_SQL, RAW_QUOTES_SQL, allocations, daily_values, entities, fund_daily, raw_quotes, with_entities,
)
from panelmill.sources import workbooks
from panelmill.sources.closes import MonthCloses, closes_schema
from panelmill.sources.shared import new_path
from panelmill.sources.versioned import VersionedTable

BULK_BEFORE, LATE_DAY = "2000-06-01", "2000-01-17"
NEW_DAYS = ("2000-06-01", "2000-06-02", "2000-06-03", "2000-06-04", "2000-06-05")
READ_FROM, READ_TO = "1999-12-01", "2000-06-04"
PROFILE_RANGES = (("1992-01-01", "2001-12-31"), ("1995-01-01", "1995-12-31"), ("1998-03-05", "1998-03-11"))
QUARTILES, BINS = (0.25, 0.5, 0.75), 10
PRICE_HEADINGS = {name: heading for heading, name in schema.PRICE_NAMES.items()} | {"fund_type": "sheet"}


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _staged_days(spark: SparkSession, d: str) -> DataFrame:
    """A bulk load by months, five days one after the other (one of them wrong), then that day and a late one again."""
    panel = fund_daily(spark, d)
    staged = VersionedTable(spark, new_path(spark, "panel"), T.StructType([T.StructField(f.name, f.dataType) for f in panel.schema]))
    staged.replace_all(panel.filter(F.col("date") < F.lit(BULK_BEFORE).cast("date")))
    for at in NEW_DAYS:
        rows = panel.filter(F.col("date") == F.lit(at).cast("date"))
        staged.add_days(rows.withColumn("price", F.col("price") * 2) if at == NEW_DAYS[2] else rows)
    staged.add_days(panel.filter(F.col("date").isin(*(F.lit(at).cast("date") for at in (NEW_DAYS[2], LATE_DAY)))))
    return staged.read(READ_FROM, READ_TO)


def _closes_by_days(spark: SparkSession, d: str) -> DataFrame:
    """Month closes from the panel's days in three lots, none of which is in order."""
    panel = daily_values(spark, d)
    closes = MonthCloses(spark, new_path(spark, "closes"), closes_schema(panel))
    for lot in (2, 0, 1):
        closes.add(panel.filter(F.dayofmonth("date") % 3 == lot))
    return with_entities(spark, d, closes.read())


def _running_measures(spark: SparkSession, d: str) -> DataFrame:
    """A code's whole history by years: no task gets more than a year of it."""
    year = F.year("date")
    first = running(fund_daily(spark, d).select("code", "date", "price"), ["code"], year, number="counter",
                    previous={"previous_price": "price"}, indexed={"price_indexed": "price"})
    gains = first.withColumn("gain", simple_return(F.col("price"), F.col("previous_price")))
    return rounded(running(gains, ["code"], year, growth={"growth": "gain"}, risk={"stdev": "gain"}), "gain", "price_indexed", "growth", "stdev")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _written(pickers.bitmap_index(_written(pickers.numbered(_pickable(spark, d)), "entities")), "index")


def _picker(column: str, q: compare.Comparison | None = None):
    return lambda s, d: pickers.choices(_index(s, d), column, q)


def _from_cube(q: compare.Comparison, metric: str, alias: str | None = None):
    """The returns summed up once, and a comparison read from the smallest cuboid that has its columns."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = new_path(spark, "cube")
        cube.write_cube(bq._returns(spark, d), path)
        out = rounded(cube.compare_from_cube(spark, path, q, metric, alias), "avg_monthly_gain")
        return rounded(out, alias or metric, digits=bq.METRIC_DIGITS[metric])
    return run


def _by_rules(spark: SparkSession, d: str) -> DataFrame:
    """The overrides, which are for whole names, as rows; the last of them wins, so positions run backwards."""
    plain = [o._replace(pattern=o.pattern.removeprefix("^").removesuffix(" ?$")) for o in qq._OVERRIDES]
    table = spark.createDataFrame([(-i, o.pattern, True, o.code, o.name, o.kind) for i, o in enumerate(plain)], rules.RULES)
    return rules.conform_by_rules(qq._companies(spark, d), qq._named_funds(spark, d), table, dropped=("C4", "C9"), recoded={"C14": "CX"})


def _profile_by_days(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of ranges of days from stored day profiles. Estimates vary within their error, so the result says whether
    each keeps within twice the stated rank error, and five standard deviations of the codes, of the raw rows."""
    quotes = raw_quotes(spark, d)
    profiles = _written(sketches.day_profiles(quotes), "profiles")
    return reduce(DataFrame.unionByName, [_range_checked(quotes, profiles, *days) for days in PROFILE_RANGES])


def _range_checked(quotes: DataFrame, profiles: DataFrame, start: str, end: str) -> DataFrame:
    merged = _written(sketches.merged_profile(profiles, start, end, quantiles=QUARTILES), "merged")
    found = merged.select("quantiles").scalar()
    at = [F.get(found, F.lit(i)) for i in range(len(QUARTILES))]
    rows = quotes.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    exact = rows.agg(
        F.count_distinct("code").alias("codes"), F.count("price").alias("values"),
        *[F.count_if(F.col("price") < v).alias(f"below_{i}") for i, v in enumerate(at)],
        *[F.count_if(F.col("price") <= v).alias(f"up_to_{i}") for i, v in enumerate(at)])
    ranks = [sketches.within(F.lit(q), 2 * sketches.rank_error(), f"below_{i}", f"up_to_{i}") for i, q in enumerate(QUARTILES)]
    checked = exact.select(F.struct(F.col("codes").alias("codes"), reduce(Column.__and__, ranks).alias("ok"))).scalar()
    apart = F.abs(F.col("codes") - checked["codes"]) <= checked["codes"] * sketches.distinct_error(deviations=5)
    return merged.select(
        F.lit(start).alias("first_day"), F.lit(end).alias("last_day"), "rows", "null_code", "null_name", "null_price", "null_shares",
        "null_category", "zero_or_missing", "values", apart.alias("codes_within"), checked["ok"].alias("quartiles_within"))


def _quantile_hist(spark: SparkSession, d: str) -> DataFrame:
    """Bins of equally many rows from rank summaries by day: rows in all bins, and whether each edge keeps within twice
    the stated rank error."""
    panel = fund_daily(spark, d).select("date", "contribution", "total_value")
    days = _written(sketches.rank_summaries(panel, "total_value", ["date", "contribution"]), "summaries")
    edges = _written(sketches.quantile_edges(sketches.merged_summaries(days, ["contribution"]), ["contribution"], BINS), "edges")
    bins = sketches.quantile_histogram(panel, "total_value", edges, "contribution")
    counts = bins.groupBy("contribution").agg(F.sum("count").alias("rows_in_bins"))
    ranks = sketches.edge_ranks(panel, "total_value", edges, "contribution", BINS + 1)
    near = ranks.groupBy("contribution").agg(
        F.any_value("values").alias("values"),
        F.every(sketches.within(F.col("edge") / BINS, 2 * sketches.rank_error())).alias("edges_within"))
    return near.join(counts, "contribution")


def _consolidate_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Prices and allocations written as workbooks with a sheet per fund type, read back and consolidated."""
    panel = fund_daily(spark, d).select(*[F.col(c).alias(h) for c, h in PRICE_HEADINGS.items()])
    prices = workbooks.read_price_workbooks(_written(workbooks.to_workbooks(panel, "sheet"), "prices"))
    shares = allocations(spark, d).withColumnRenamed("fund_type", "sheet")
    kind = T.StructType([f for f in shares.schema if f.name != "sheet"])
    read = workbooks.read_workbooks(_written(workbooks.to_workbooks(shares, "sheet"), "allocations"), kind)
    return consolidate_daily(
        prices.withColumn("people", F.col("people").cast("long")).drop("path", workbooks.BAD_CELLS),
        read.withColumnRenamed("sheet", "fund_type").drop("path", workbooks.BAD_CELLS),
        entities(spark, d).select("code", "category"))


def _profile_sql(start: str, end: str) -> str:
    counts = ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS null_{c}" for c in sketches.PROFILED)
    return f"""SELECT '{start}' AS first_day, '{end}' AS last_day, COUNT(*) AS rows, {counts},
      COUNT(*) FILTER (price IS NULL OR shares IS NULL OR price = 0 OR shares = 0) AS zero_or_missing, COUNT(price) AS values,
      TRUE AS codes_within, TRUE AS quartiles_within FROM raw_quotes WHERE date BETWEEN DATE '{start}' AND DATE '{end}'"""


QUERIES = {
    "consolidate_from_workbooks": Entry(_consolidate_workbooks, qq.QUERIES["consolidate_daily"].sql),
    "profile_by_days": Entry(_profile_by_days, with_views(
        " UNION ALL ".join(_profile_sql(*days) for days in PROFILE_RANGES), RAW_QUOTES_SQL)),
    "valuation_quantile_hist": Entry(_quantile_hist, with_views(
        """SELECT contribution, COUNT(total_value) AS values, CAST(COUNT(total_value) AS BIGINT) AS rows_in_bins, TRUE AS edges_within
        FROM fund_daily GROUP BY contribution""", FUND_DAILY_SQL)),
    "compare_growth_cube": Entry(_from_cube(bq.BY_TYPE, "growth_rate", "cumulative_change"), bq.QUERIES["compare_growth"].sql),
    "compare_risk_cube": Entry(_from_cube(bq.BY_NAME, "stdev"), bq.QUERIES["compare_risk"].sql),
    "compare_companies_cube": Entry(_from_cube(bq.BY_COMPANY_LIST, "growth_rate"), bq.QUERIES["compare_companies"].sql),
    "conform_companies_by_rules": Entry(_by_rules, qq.QUERIES["conform_companies"].sql),
    "staged_days": Entry(_staged_days, with_views(
        f"SELECT * FROM fund_daily WHERE date BETWEEN DATE '{READ_FROM}' AND DATE '{READ_TO}'", FUND_DAILY_SQL)),
    "monthly_close_by_days": Entry(_closes_by_days, with_views("SELECT * FROM fund_monthly", FUND_MONTHLY_SQL)),
    "running_measures": Entry(_running_measures, with_views("""
      SELECT code, date, price, counter, previous_price, ROUND(price_indexed, 6) AS price_indexed, ROUND(gain, 6) AS gain,
        ROUND(product(gain + 1) OVER w, 6) AS growth, ROUND(stddev_pop(gain) OVER w, 6) AS stdev
      FROM (SELECT code, date, price, CAST(row_number() OVER w AS INTEGER) AS counter, lag(price) OVER w AS previous_price,
              price / NULLIF(first_value(price) OVER w, 0) AS price_indexed, price / NULLIF(lag(price) OVER w, 0) - 1 AS gain
            FROM fund_daily WINDOW w AS (PARTITION BY code ORDER BY date))
      WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)""", FUND_DAILY_SQL)),
    "choices_category_indexed": Entry(
        _picker("category", compare.Comparison(fund_types=("ASIA", benchmark.LABEL), contribution=(True,))),
        _choices_sql("category", "fund_type IN ('ASIA', 'benchmark') AND contribution")),
    "choices_company_indexed": Entry(
        _picker("company_name", compare.Comparison(fund_types=REGIONS, OKS=(False,))),
        _choices_sql("company_name", "fund_type <> 'benchmark' AND NOT OKS")),
    "choices_fund_indexed": Entry(
        _picker("name", compare.Comparison(fund_types=TYPES, categories=("NATION_1", "NATION_6"))),
        _choices_sql("name", "category IN ('NATION_1', 'NATION_6')")),
}
