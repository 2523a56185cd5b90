"""Monthly layer, benchmarks, cohort and parameterised comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators import benchmark, cohort, compare, monthly
from panelmill.operators.returns import monthly_returns
from panelmill.plans.common import Entry, rounded, with_views
from panelmill.plans.views import (
    BENCHMARK_MONTHS_SQL, FUND_MONTHLY_SQL, SERIES, benchmark_daily, benchmark_months, daily_values, entities, fund_monthly,
    fund_monthly_between, table, with_entities,
)
from panelmill.sources.crosstab import crosstab_series

FIRST_MONTH, DROP_LAST = "1995-06-01", 2
BASES = {f"s{i}": (name, 250000.0) for i, name in enumerate(SERIES, 1)}
SHOWN = ("s1", "s2", "s3", "s4")
JOIN_BEFORE = "2001-06-10"
SEEN_BEFORE, AFTER = "1995-03-05", "1996-01-15"
FIRST, LAST = "1999-11-01", "2000-11-01"
COMPARED = {"usd": "b_1", "gold": "b_2", "xu100": "b_3"}


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.benchmark_wide(benchmark_months(spark, d), SERIES, FIRST_MONTH, DROP_LAST)


def _union(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.panel_with_benchmarks(fund_monthly(spark, d), benchmark.benchmark_long(_wide(spark, d), SERIES))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.panel_join_benchmark(fund_monthly(spark, d), _wide(spark, d), before=JOIN_BEFORE)


def _month_dated(spark: SparkSession, d: str) -> DataFrame:
    """Joined panel dated by month, so that two anchor dates hold most codes."""
    return _joined(spark, d).withColumn("date", F.make_date("year", "month", F.lit(1)))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return cohort.cohort_index(_month_dated(spark, d), SEEN_BEFORE, AFTER)


def _performance(spark: SparkSession, d: str) -> DataFrame:
    return cohort.relative_performance(_index(spark, d), FIRST, LAST, COMPARED)


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return monthly_returns(_union(spark, d))


def _returns_between(spark: SparkSession, d: str, start: str, end: str) -> DataFrame:
    """The returns of some months, from lines of these months and each code's last day before them.

    The panel has one close per code from before ``start``, so only the end is left to bound; the comparison
    itself leaves out what is before ``start``.
    """
    panel = fund_monthly_between(spark, d, start, end)
    series = benchmark.benchmark_long(_wide(spark, d), SERIES)
    return monthly_returns(benchmark.panel_with_benchmarks(panel, series), end=end)


_SERIES_SQL = ", ".join(SERIES)
_WIDE_VIEWS = (BENCHMARK_MONTHS_SQL, f"""pivoted AS (
  SELECT date, {", ".join(f"max(CASE WHEN name = '{n}' THEN price END) AS {n}" for n in SERIES)}
  FROM benchmark_months WHERE date >= DATE '{FIRST_MONTH}' GROUP BY date),
wide AS (SELECT * FROM pivoted WHERE date NOT IN (SELECT date FROM pivoted ORDER BY date DESC LIMIT {DROP_LAST}))""")
_LONG_VIEW = f"""long AS (
  SELECT date, name, price, name AS code, 'benchmark' AS fund_type, 'benchmark' AS category,
    'benchmark' AS company_code, 'benchmark' AS company_name, FALSE AS OKS, FALSE AS participation, FALSE AS contribution
  FROM wide UNPIVOT INCLUDE NULLS (price FOR name IN ({_SERIES_SQL})))"""
_UNION_VIEW = "merged AS (SELECT * FROM fund_monthly UNION ALL BY NAME SELECT * FROM long)"
_UNION_VIEWS = (FUND_MONTHLY_SQL, *_WIDE_VIEWS, _LONG_VIEW, _UNION_VIEW)
_JOINED_VIEW = f"""joined AS (
  SELECT data_date AS date, f.year, f.month, fund_type, category, company_name, company_code, name, code, price,
    total_value, shares, {_SERIES_SQL}
  FROM fund_monthly f LEFT JOIN (
    SELECT year(date - 15) AS year, month(date - 15) AS month, {_SERIES_SQL} FROM wide) b
    ON f.year = b.year AND f.month = b.month
  WHERE data_date < DATE '{JOIN_BEFORE}')"""
_INDEX_VIEW = f"""dated AS (SELECT * REPLACE (make_date(year, month, 1) AS date) FROM joined),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS counter,
    price / NULLIF(first_value(price) OVER (PARTITION BY code ORDER BY date), 0) AS price_indexed
  FROM dated WHERE date > DATE '{AFTER}'
    AND code IN (SELECT code FROM dated WHERE date < DATE '{SEEN_BEFORE}'))"""
_IDENTITY = ", ".join(cohort.IDENTITY)
_PERFORMANCE_VIEW = f"""performance AS (
  SELECT counter, date, year, month, {_IDENTITY}, prv_price, price, price_indexed, total_value, shares,
    {", ".join(f"{c}, prv_{n}, {c} / NULLIF(prv_{n}, 0) AS chng_{n}" for n, c in COMPARED.items())}
  FROM (SELECT *, lag(price_indexed) OVER w AS prv_price,
          {", ".join(f"lag({c}) OVER w AS prv_{n}" for n, c in COMPARED.items())}
        FROM indexed WHERE date IN (DATE '{FIRST}', DATE '{LAST}')
        WINDOW w AS (PARTITION BY {_IDENTITY} ORDER BY date))
  WHERE date = DATE '{LAST}'),
classed AS (SELECT *, CASE WHEN price_indexed > chng_usd THEN 'excellent profit' WHEN price_indexed < 1 THEN 'loss'
  WHEN price_indexed <= chng_usd THEN 'profit but less than usd' END AS profit FROM performance)"""
_COHORT_VIEWS = (FUND_MONTHLY_SQL, *_WIDE_VIEWS, _JOINED_VIEW, _INDEX_VIEW, _PERFORMANCE_VIEW)
_RETURNS_VIEW = """returns AS (
  SELECT *, price / NULLIF(lag(price) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS monthly_price_change FROM merged)"""
_RETURNS_VIEWS = (*_UNION_VIEWS, _RETURNS_VIEW)
_BEST = "fund_type, category, company_code, code, price_indexed"

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FUNDS = ("Supplier#000000001", "Supplier#000000002", "Supplier#000000005")
TYPES = (*REGIONS, benchmark.LABEL)
BY_TYPE = compare.Comparison(FIRST, LAST, ("fund_type",), TYPES, missing="drop")
BY_COMPANY = compare.Comparison(
    FIRST, LAST, ("company_name", "contribution"), ("ASIA", "EUROPE", benchmark.LABEL), contribution=(True,),
    categories=("NATION_2", "NATION_3", "NATION_7", "NATION_8", benchmark.LABEL))
BY_NAME = compare.Comparison(FIRST, LAST, ("name",), TYPES, benchmarks=("b_1", "b_2"))
BY_COMPANY_LIST = compare.Comparison(FIRST, LAST, ("company_name", "fund_type"), TYPES, companies=("CO_1", "CO_4"))
BY_FUND = compare.Comparison(FIRST, LAST, ("name",), TYPES, funds=FUNDS)
OVERALL = compare.Comparison(FIRST, LAST, (), REGIONS)

# Growth reaches 1e8 on this data, where a double holds fewer decimal places than a deviation has.
METRIC_DIGITS = {"growth_rate": 3, "stdev": 6}


def _compare_sql(groups: tuple[str, ...], metric: str, where: str, gain: str = "monthly_price_change",
                 alias: str | None = None) -> str:
    keys = ", ".join(groups)
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    value = {"growth_rate": "product(gain + 1)", "stdev": "stddev_pop(gain)"}[metric]
    digits = METRIC_DIGITS[metric]
    return with_views(f"""SELECT {lead}date, ROUND(gain, 6) AS avg_monthly_gain,
  ROUND({value} OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING), {digits}) AS {alias or metric}
FROM (SELECT {lead}date, avg({gain}) AS gain FROM returns
  WHERE date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND {where} GROUP BY {lead}date)""", *_RETURNS_VIEWS)


def _compare(spark: SparkSession, d: str, q: compare.Comparison, metric: str, alias: str | None = None) -> DataFrame:
    returns = _returns_between(spark, d, q.start, q.end)
    result = rounded(compare.compare(returns, q, metric, alias), "avg_monthly_gain")
    return rounded(result, alias or metric, digits=METRIC_DIGITS[metric])


_ZEROED = "COALESCE(monthly_price_change, 0)"
_COMPANY_WHERE = """fund_type IN ('ASIA', 'EUROPE', 'benchmark') AND contribution
  AND category IN ('NATION_2', 'NATION_3', 'NATION_7', 'NATION_8', 'benchmark')"""


def _pickable(spark: SparkSession, d: str) -> DataFrame:
    """What there is to pick from: funds with any line, and the series. A picker needs no prices and no months."""
    dated = table(spark, d, "lineitem").filter("l_shipdate IS NOT NULL")
    funds = entities(spark, d).join(dated.selectExpr("CAST(l_suppkey AS STRING) AS code").distinct(), "code", "left_semi")
    series = benchmark.benchmark_long(_wide(spark, d), SERIES)
    return funds.unionByName(series.select(*funds.columns))


def _choices(column: str, q: compare.Comparison | None = None):
    return lambda s, d: compare.choices(_pickable(s, d), column, q)


def _choices_sql(column: str, where: str = "TRUE") -> str:
    return with_views(f"SELECT 'ALL' AS choice UNION ALL SELECT * FROM (SELECT DISTINCT {column} FROM merged WHERE {where})",
                      *_UNION_VIEWS)


def _crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Order totals laid out like the crosstab file (year on the first month only), then read back."""
    day = F.col("o_orderdate").cast("date")
    month = F.trunc(day, "month")
    totals = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("start")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    first = F.min("start").over(Window.partitionBy("series", F.year("start")))
    rows = totals.select(
        "series", F.when(F.col("start") == first, F.date_format("start", "yyyy")).alias("year"),
        F.concat(F.date_format("start", "MM"), F.lit("-"), F.lit("Ay")).alias("month"),
        (F.col("cents") / 100.0).cast("string").alias("value"),
        F.quarter("start").alias("quarter"), F.year("start").alias("block"), F.col("start").alias("line"))
    return crosstab_series(
        rows.withColumn("split", F.col("block") * 10 + F.col("quarter")), ["series"], "split", "line")


QUERIES = {
    "monthly_close": Entry(
        lambda s, d: with_entities(s, d, monthly.monthly_close(daily_values(s, d))),
        with_views("SELECT * FROM fund_monthly", FUND_MONTHLY_SQL)),
    "benchmark_month_end": Entry(
        lambda s, d: monthly.month_end(benchmark_daily(s, d)),
        with_views("SELECT * FROM benchmark_months", BENCHMARK_MONTHS_SQL)),
    "cpi_crosstab": Entry(
        _crosstab,
        """SELECT o_orderpriority AS series, make_date(year(o_orderdate), month(o_orderdate), 1) AS date,
          CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price
          FROM orders GROUP BY o_orderpriority, year(o_orderdate), month(o_orderdate)"""),
    "benchmark_wide": Entry(_wide, with_views("SELECT * FROM wide", *_WIDE_VIEWS)),
    "benchmark_long": Entry(
        lambda s, d: benchmark.benchmark_long(_wide(s, d), SERIES),
        with_views("SELECT * FROM long", *_WIDE_VIEWS, _LONG_VIEW)),
    "panel_with_benchmarks": Entry(_union, with_views("SELECT * FROM merged", *_UNION_VIEWS)),
    "benchmark_rebased": Entry(
        lambda s, d: benchmark.benchmark_rebased(_wide(s, d), BASES, SHOWN),
        with_views("""SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
          category, points FROM (SELECT date, """
                   + ", ".join(f"ROUND({c} / CAST({b} AS DOUBLE), 2) AS {n}" for n, (c, b) in BASES.items() if n in SHOWN)
                   + f" FROM wide) UNPIVOT INCLUDE NULLS (points FOR category IN ({', '.join(SHOWN)}))", *_WIDE_VIEWS)),
    "panel_join_benchmark": Entry(
        _joined, with_views("SELECT * FROM joined", FUND_MONTHLY_SQL, *_WIDE_VIEWS, _JOINED_VIEW)),
    "cohort_first_dates": Entry(
        lambda s, d: cohort.first_dates(_index(s, d)),
        with_views(f"""SELECT code, min(date) FILTER (date > DATE '{AFTER}') AS earliest FROM dated GROUP BY code
          HAVING min(date) < DATE '{SEEN_BEFORE}' AND max(date) > DATE '{AFTER}'""",
                   FUND_MONTHLY_SQL, *_WIDE_VIEWS, _JOINED_VIEW,
                   "dated AS (SELECT code, make_date(year, month, 1) AS date FROM joined)")),
    "cohort_index": Entry(
        lambda s, d: _index(s, d).withColumn("counter", F.col("counter").cast("bigint")),
        with_views("SELECT * FROM indexed", *_COHORT_VIEWS)),
    "relative_performance": Entry(
        lambda s, d: _performance(s, d).withColumn("counter", F.col("counter").cast("bigint")),
        with_views("SELECT * FROM performance", *_COHORT_VIEWS)),
    "profit_class": Entry(
        lambda s, d: cohort.profit_class(_performance(s, d)).select("code", "category", "price_indexed", "chng_usd", "profit"),
        with_views("SELECT code, category, price_indexed, chng_usd, profit FROM classed", *_COHORT_VIEWS)),
    "profit_counts": Entry(
        lambda s, d: cohort.profit_counts(cohort.profit_class(_performance(s, d))),
        with_views("SELECT category, profit, count(*) AS n FROM classed WHERE profit IS NOT NULL "
                   "GROUP BY category, profit", *_COHORT_VIEWS)),
    "best_k": Entry(
        lambda s, d: cohort.best_k(_performance(s, d)),
        with_views(f"SELECT {_BEST} FROM performance ORDER BY price_indexed DESC NULLS LAST, code LIMIT 50",
                   *_COHORT_VIEWS)),
    "best_k_offset": Entry(
        lambda s, d: cohort.best_k(_performance(s, d), 10, skip=1),
        with_views(f"SELECT {_BEST} FROM performance ORDER BY price_indexed DESC NULLS LAST, code LIMIT 10 OFFSET 1",
                   *_COHORT_VIEWS)),
    "best_k_series": Entry(
        lambda s, d: cohort.series_of(_index(s, d), cohort.best_k(_performance(s, d), 10, skip=1)).select(
            "code", "name", "date", "price", "price_indexed", "b_1"),
        with_views("""SELECT code, name, date, price, price_indexed, b_1 FROM indexed WHERE code IN (
          SELECT code FROM performance ORDER BY price_indexed DESC NULLS LAST, code LIMIT 10 OFFSET 1)""",
                   *_COHORT_VIEWS)),
    "monthly_returns": Entry(
        lambda s, d: _returns(s, d).select("code", "name", "fund_type", "date", "price", "monthly_price_change"),
        with_views("SELECT code, name, fund_type, date, price, monthly_price_change FROM returns", *_RETURNS_VIEWS)),
    "compare_growth": Entry(
        lambda s, d: _compare(s, d, BY_TYPE, "growth_rate", "cumulative_change"),
        _compare_sql(("fund_type",), "growth_rate", "monthly_price_change IS NOT NULL", alias="cumulative_change")),
    "compare_growth_filtered": Entry(
        lambda s, d: _compare(s, d, BY_COMPANY, "growth_rate"),
        _compare_sql(("company_name", "contribution"), "growth_rate", _COMPANY_WHERE, _ZEROED)),
    "compare_risk": Entry(
        lambda s, d: _compare(s, d, BY_NAME, "stdev"),
        _compare_sql(("name",), "stdev", "(name IN ('b_1', 'b_2') OR fund_type <> 'benchmark')", _ZEROED)),
    "compare_risk_overall": Entry(
        lambda s, d: _compare(s, d, OVERALL, "stdev"),
        _compare_sql((), "stdev", "fund_type <> 'benchmark'", _ZEROED)),
    "compare_companies": Entry(
        lambda s, d: _compare(s, d, BY_COMPANY_LIST, "growth_rate"),
        _compare_sql(("company_name", "fund_type"), "growth_rate", "company_name IN ('CO_1', 'CO_4')", _ZEROED)),
    "compare_funds": Entry(
        lambda s, d: _compare(s, d, BY_FUND, "stdev"),
        _compare_sql(("name",), "stdev", "name IN (SELECT s_name FROM supplier WHERE s_suppkey IN (1, 2, 5))", _ZEROED)),
    "choices_category": Entry(
        _choices("category", compare.Comparison(fund_types=("ASIA", benchmark.LABEL), contribution=(True,))),
        _choices_sql("category", "fund_type IN ('ASIA', 'benchmark') AND contribution")),
    "choices_company": Entry(
        _choices("company_name", compare.Comparison(fund_types=REGIONS, OKS=(False,))),
        _choices_sql("company_name", "fund_type <> 'benchmark' AND NOT OKS")),
    "choices_fund": Entry(
        _choices("name", compare.Comparison(fund_types=TYPES, categories=("NATION_1", "NATION_6"))),
        _choices_sql("name", "category IN ('NATION_1', 'NATION_6')")),
}
