"""Coverage, returns, risk, rankings and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmill.operators import coverage, histogram, movers, returns
from panelmill.plans.common import Entry, rounded, with_views
from panelmill.plans.views import FUND_DAILY_SQL, FUND_MONTHLY_SQL, fund_daily, fund_monthly

START, GRACE_DAYS = "1999-11-15", 30
FIRST, LAST = "1999-11-01", "2000-11-01"
CUTOFF = "1995-01-10"
ENTITY = "code, fund_type, category, company_name"
FIGURES = ("avg_daily_change", "stdev", "annual_change")
LOGS = tuple(f"log_{c}" for c in FIGURES)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return returns.daily_change_stats(fund_daily(spark, d), START, GRACE_DAYS)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Month closes of the two anchor months only."""
    return fund_monthly(spark, d, FIRST, LAST)


def _annual(spark: SparkSession, d: str) -> DataFrame:
    return returns.annual_change(_anchors(spark, d), FIRST, LAST)


def _risk(spark: SparkSession, d: str) -> DataFrame:
    return returns.risk_return(_annual(spark, d), _daily(spark, d))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return returns.two_date_compare(_anchors(spark, d), FIRST, LAST)


_DAILY_VIEW = f"""daily AS (
  SELECT {ENTITY}, avg(chg) AS avg_daily_change, stddev_samp(chg) AS stdev, min(date) AS earliest, count(*) AS count
  FROM (SELECT *, price / NULLIF(lag(price) OVER (PARTITION BY {ENTITY} ORDER BY date), 0) - 1 AS chg FROM fund_daily)
  WHERE date >= DATE '{START}' GROUP BY {ENTITY}
  HAVING min(date) <= DATE '{START}' + {GRACE_DAYS})"""
_ANNUAL_VIEW = f"""annual AS (
  SELECT * FROM (
    SELECT *, price / NULLIF(lag(price) OVER (PARTITION BY {ENTITY} ORDER BY date), 0) - 1 AS annual_change
    FROM fund_monthly WHERE date IN (DATE '{FIRST}', DATE '{LAST}'))
  WHERE annual_change IS NOT NULL)"""


def _logs(alias: dict[str, str]) -> str:
    return ", ".join(
        f"ROUND(CASE WHEN {alias[c]}.{c} > 0 THEN log10({alias[c]}.{c}) END, 6) AS log_{c}" for c in FIGURES)


_SIDES = {"avg_daily_change": "d", "stdev": "d", "annual_change": "a"}
_RISK_COLUMNS = f"""a.code, a.fund_type, a.category, a.company_name, a.OKS, a.participation, a.contribution,
  a.price, ROUND(d.avg_daily_change, 6) AS avg_daily_change, ROUND(d.stdev, 6) AS stdev,
  ROUND(a.annual_change, 6) AS annual_change, {_logs(_SIDES)}"""
_KEPT = ("code", "fund_type", "category", "company_name", "OKS", "participation", "contribution", "price",
         *FIGURES, *LOGS)
_RISK_VIEWS = (FUND_MONTHLY_SQL, _DAILY_VIEW, _ANNUAL_VIEW)
_RISK = with_views(f"SELECT {_RISK_COLUMNS} FROM annual a LEFT JOIN daily d USING (code)", *_RISK_VIEWS)


def _risk_by(*keys: str, where: str = "TRUE") -> str:
    cols = ", ".join(f"a.{k}" for k in keys)
    return with_views(f"""SELECT {cols}, ROUND(avg(d.avg_daily_change), 6) AS avg_daily_change,
  ROUND(avg(d.stdev), 6) AS stdev, ROUND(avg(a.annual_change), 6) AS annual_change
FROM annual a LEFT JOIN daily d USING (code) WHERE {where} GROUP BY {cols}""", *_RISK_VIEWS)


def _kept(df: DataFrame) -> DataFrame:
    return rounded(df.select(*_KEPT), *FIGURES, *LOGS)


_SPAN = """count(*) AS count, max(date) AS latest, min(date) AS earliest,
  CAST(max(date) - min(date) AS INTEGER) AS length"""

_COMPARED_VIEW = f"""compared AS (
  SELECT date, fund_type, category, code, name, price, previous_price,
    (price - previous_price) * 100 / NULLIF(previous_price, 0) AS change_price_percentage,
    total_value, previous_total_value,
    (total_value - previous_total_value) * 100 / NULLIF(previous_total_value, 0) AS change_total_value_percentage
  FROM (SELECT *, lag(price) OVER w AS previous_price, lag(total_value) OVER w AS previous_total_value
        FROM fund_monthly WHERE date IN (DATE '{FIRST}', DATE '{LAST}')
        WINDOW w AS (PARTITION BY code, name ORDER BY date))
  WHERE date = DATE '{LAST}')"""
_COMPARED = with_views("SELECT * FROM compared", FUND_MONTHLY_SQL, _COMPARED_VIEW)
_MOVER_COLUMNS = "fund_type, category, code, name, previous_price, price, change_price_percentage"


def _movers(direction: str, k: int | None = 40) -> str:
    limit = f" LIMIT {k}" if k else ""
    return (f"SELECT {_MOVER_COLUMNS} FROM compared ORDER BY change_price_percentage {direction} NULLS LAST, code{limit}")


def _mix(direction: str) -> str:
    return with_views(f"SELECT category, count(*) AS n FROM ({_movers(direction)}) GROUP BY category",
                      FUND_MONTHLY_SQL, _COMPARED_VIEW)


_VALUATION_VIEW = f"""valued AS (
  SELECT code, contribution, fund_type, people, total_value,
    CAST(ROUND(CAST(total_value AS DECIMAL(28,2)) / CAST(1000000 AS DECIMAL(10,0)), 2) AS DOUBLE) AS total_value_millions,
    CAST(floor(total_value / 10000000) AS BIGINT) AS total_value_bins
  FROM fund_monthly WHERE date = DATE '{LAST}')"""


def _histogram(value: str, facet: str) -> str:
    return with_views(f"""SELECT {facet}, CAST(LEAST(COALESCE(floor(CAST({value} - lo AS DOUBLE)
    / NULLIF(hi - lo, 0) * 50), 0), 49) AS INTEGER) AS bin, count(*) AS count
FROM valued, (SELECT min({value}) AS lo, max({value}) AS hi FROM valued)
WHERE {value} IS NOT NULL GROUP BY 1, 2""", FUND_MONTHLY_SQL, _VALUATION_VIEW)


QUERIES = {
    "entity_counts_total": Entry(
        lambda s, d: coverage.entity_counts(fund_daily(s, d)),
        with_views("SELECT count(DISTINCT code) AS count FROM fund_daily", FUND_DAILY_SQL)),
    "entity_counts_by_type": Entry(
        lambda s, d: coverage.entity_counts(fund_daily(s, d), ["fund_type"]),
        with_views("SELECT fund_type, count(DISTINCT code) AS count FROM fund_daily GROUP BY fund_type", FUND_DAILY_SQL)),
    "entity_counts_by_category": Entry(
        lambda s, d: coverage.entity_counts(fund_daily(s, d), ["fund_type", "category"]),
        with_views("SELECT fund_type, category, count(DISTINCT code) AS count FROM fund_daily "
                   "GROUP BY fund_type, category", FUND_DAILY_SQL)),
    "calendar_coverage": Entry(
        lambda s, d: coverage.calendar_coverage(fund_daily(s, d)),
        with_views(f"SELECT {_SPAN} FROM (SELECT DISTINCT date FROM fund_daily)", FUND_DAILY_SQL)),
    "entity_coverage": Entry(
        lambda s, d: coverage.entity_coverage(fund_daily(s, d)),
        with_views(f"""SELECT code, fund_type, category, {_SPAN},
          count(*) / CAST(NULLIF(max(date) - min(date), 0) AS DOUBLE) AS coverage
          FROM fund_daily GROUP BY code, fund_type, category""", FUND_DAILY_SQL)),
    "history_years_hist": Entry(
        lambda s, d: coverage.history_years(fund_daily(s, d)),
        with_views("""SELECT CAST(floor(length / 365) AS INTEGER) AS length_years, count(*) AS codes
          FROM (SELECT code, max(date) - min(date) AS length FROM fund_daily GROUP BY code) GROUP BY 1""",
                   FUND_DAILY_SQL)),
    "min_history": Entry(
        lambda s, d: coverage.min_history(fund_daily(s, d), CUTOFF),
        with_views(f"SELECT code, {_SPAN} FROM fund_daily GROUP BY code HAVING min(date) <= DATE '{CUTOFF}'",
                   FUND_DAILY_SQL)),
    "min_history_by_type": Entry(
        lambda s, d: coverage.min_history(fund_daily(s, d), "1995-01-05", ["code", "fund_type"]),
        with_views(f"""SELECT code, fund_type, {_SPAN} FROM fund_daily GROUP BY code, fund_type
          HAVING min(date) <= DATE '1995-01-05'""", FUND_DAILY_SQL)),
    "daily_change_stats": Entry(
        lambda s, d: rounded(_daily(s, d), "avg_daily_change", "stdev"),
        with_views(f"""SELECT {ENTITY}, ROUND(avg_daily_change, 6) AS avg_daily_change, ROUND(stdev, 6) AS stdev,
          earliest, count FROM daily""", FUND_DAILY_SQL, _DAILY_VIEW)),
    "annual_change": Entry(
        lambda s, d: _annual(s, d),
        with_views("SELECT * FROM annual", FUND_MONTHLY_SQL, _ANNUAL_VIEW)),
    "risk_return": Entry(lambda s, d: _kept(_risk(s, d)), _RISK),
    "risk_return_daily_base": Entry(
        lambda s, d: rounded(
            returns.risk_return(_annual(s, d), _daily(s, d), base="daily"), *FIGURES, *LOGS),
        with_views(f"""SELECT d.code, d.fund_type, d.category, d.company_name, d.earliest, d.count,
          ROUND(d.avg_daily_change, 6) AS avg_daily_change, ROUND(d.stdev, 6) AS stdev,
          ROUND(a.annual_change, 6) AS annual_change, {_logs(_SIDES)}
          FROM daily d LEFT JOIN annual a USING (code)""", *_RISK_VIEWS)),
    "risk_return_by_category": Entry(
        lambda s, d: rounded(returns.risk_return_by_category(_risk(s, d)), *FIGURES), _risk_by("category", "fund_type")),
    "risk_return_by_company": Entry(
        lambda s, d: rounded(returns.risk_return_by_company(_risk(s, d)), *FIGURES),
        _risk_by("company_name", "fund_type")),
    "risk_return_flagged": Entry(
        lambda s, d: _kept(returns.subset(_risk(s, d), contribution=True)),
        with_views(f"SELECT {_RISK_COLUMNS} FROM annual a LEFT JOIN daily d USING (code) WHERE a.contribution",
                   *_RISK_VIEWS)),
    "risk_return_types": Entry(
        lambda s, d: rounded(
            returns.risk_return_by_category(returns.subset(_risk(s, d), fund_type=["ASIA", "EUROPE"])), *FIGURES),
        _risk_by("category", "fund_type", where="a.fund_type IN ('ASIA', 'EUROPE')")),
    "risk_return_categories": Entry(
        lambda s, d: _kept(returns.subset(_risk(s, d), category=["NATION_2", "NATION_7", "NATION_11"])),
        with_views(f"""SELECT {_RISK_COLUMNS} FROM annual a LEFT JOIN daily d USING (code)
          WHERE a.category IN ('NATION_2', 'NATION_7', 'NATION_11')""", *_RISK_VIEWS)),
    "two_date_compare": Entry(_compared, _COMPARED),
    "movers_table": Entry(
        lambda s, d: movers.movers_table(_compared(s, d)),
        with_views(_movers("DESC", None), FUND_MONTHLY_SQL, _COMPARED_VIEW)),
    "top_movers": Entry(
        lambda s, d: movers.top_movers(_compared(s, d)),
        with_views(_movers("DESC"), FUND_MONTHLY_SQL, _COMPARED_VIEW)),
    "bottom_movers": Entry(
        lambda s, d: movers.bottom_movers(_compared(s, d)),
        with_views(_movers("ASC"), FUND_MONTHLY_SQL, _COMPARED_VIEW)),
    "mover_category_mix_top": Entry(
        lambda s, d: movers.category_mix(movers.top_movers(_compared(s, d))), _mix("DESC")),
    "mover_category_mix_bottom": Entry(
        lambda s, d: movers.category_mix(movers.bottom_movers(_compared(s, d))), _mix("ASC")),
    "valuation_snapshot": Entry(
        lambda s, d: histogram.valuation_snapshot(fund_monthly(s, d, LAST), LAST).select(
            "code", "contribution", "fund_type", "people", "total_value", "total_value_millions", "total_value_bins"),
        with_views("SELECT * FROM valued", FUND_MONTHLY_SQL, _VALUATION_VIEW)),
    "valuation_hist": Entry(
        lambda s, d: histogram.valuation_histogram(fund_monthly(s, d, LAST), LAST),
        _histogram("total_value_millions", "contribution")),
    "investors_hist": Entry(
        lambda s, d: histogram.investors_histogram(fund_monthly(s, d, LAST), LAST), _histogram("people", "fund_type")),
}
