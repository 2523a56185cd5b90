"""Returns, rankings, histograms, monthly closes, benchmarks, cohort and comparisons on small frames."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import as_dicts
from panelmill.operators import benchmark, cohort, compare, histogram, monthly, movers, returns
from panelmill.operators.reshape import fill_forward

PANEL = "code string, fund_type string, category string, company_name string, date date, price double"


def panel_rows(code, *points, kind="m"):
    return [(code, kind, "x", "co", day, price) for day, price in points]


def test_first_return_looks_back_before_the_period(frame):
    df = frame(
        panel_rows("a", ("2019-10-01", 5.0), ("2019-11-01", 10.0), ("2019-11-15", 11.0), ("2019-11-16", 22.0))
        + panel_rows("late", ("2019-11-19", 1.0), ("2019-11-20", 2.0))
        + panel_rows("new", ("2019-11-15", 1.0), ("2019-11-16", 3.0))
        + panel_rows("gap", ("2019-11-14", None), ("2019-11-15", 4.0))
        + panel_rows("zero", ("2019-11-14", 0.0), ("2019-11-15", 4.0)), PANEL)
    rows = {r["code"]: r for r in as_dicts(returns.daily_change_stats(df, "2019-11-15", 3))}
    assert set(rows) == {"a", "new", "gap", "zero"}
    assert rows["a"]["count"] == 2
    assert rows["a"]["avg_daily_change"] == pytest.approx((0.1 + 1.0) / 2)
    assert rows["a"]["stdev"] == pytest.approx(statistics.stdev([0.1, 1.0]))
    assert (rows["new"]["avg_daily_change"], rows["new"]["stdev"]) == (2.0, None)
    assert rows["gap"]["avg_daily_change"] is None and rows["zero"]["avg_daily_change"] is None


def test_daily_stats_equal_brute_force(frame):
    rng = random.Random(7)
    start, grace = dt.date(2020, 3, 1), 5
    rows = []
    for i in range(30):
        days = sorted(rng.sample(range(120), rng.randint(1, 60)))
        rows += [(f"c{i}", "m", "x", "co", dt.date(2020, 1, 1) + dt.timedelta(d), rng.choice([0.0, rng.random()]))
                 for d in days]
    expected = {}
    for code in {r[0] for r in rows}:
        series = sorted((r[4], r[5]) for r in rows if r[0] == code)
        changes = [(d, p / q - 1 if q else None) for (d, p), q in zip(series, [None] + [p for _, p in series][:-1])]
        inside = [(d, c) for d, c in changes if d >= start]
        if inside and inside[0][0] <= start + dt.timedelta(grace):
            known = [c for _, c in inside if c is not None]
            expected[code] = (len(inside), statistics.mean(known) if known else None,
                              statistics.stdev(known) if len(known) > 1 else None)
    got = {r["code"]: r for r in as_dicts(returns.daily_change_stats(frame(rows, PANEL), "2020-03-01", grace))}
    assert set(got) == set(expected)
    for code, (n, mean, sd) in expected.items():
        assert got[code]["count"] == n
        assert got[code]["avg_daily_change"] == (pytest.approx(mean) if mean is not None else None)
        assert got[code]["stdev"] == (pytest.approx(sd) if sd is not None else None)


def test_annual_change_is_between_the_anchors_only(frame):
    df = frame(panel_rows("a", ("2019-11-15", 10.0), ("2020-05-01", 99.0), ("2020-11-16", 15.0))
               + panel_rows("b", ("2020-11-16", 15.0)), PANEL)
    rows = as_dicts(returns.annual_change(df, "2019-11-15", "2020-11-16"))
    assert [(r["code"], r["annual_change"]) for r in rows] == [("a", 0.5)]


def test_risk_return_sides(frame):
    df = frame(panel_rows("a", ("2019-11-14", 9.0), ("2019-11-15", 10.0), ("2020-11-16", 15.0))
               + panel_rows("b", ("2019-11-15", 1.0), ("2019-11-18", 2.0)), PANEL)
    annual, daily = returns.annual_change(df, "2019-11-15", "2020-11-16"), returns.daily_change_stats(df, "2019-11-15")
    assert [r["code"] for r in as_dicts(returns.risk_return(annual, daily))] == ["a"]
    both = {r["code"]: r["log_annual_change"] for r in as_dicts(returns.risk_return(annual, daily, base="daily"))}
    assert both == {"a": pytest.approx(math.log10(0.5)), "b": None}
    with pytest.raises(ValueError):
        returns.risk_return(annual, daily, base="weekly")


@pytest.fixture
def compared(frame):
    rows = [
        ("2019-11-18", "a", 10.0, 100.0), ("2020-11-16", "a", 12.0, 50.0), ("2020-11-16", "new", 1.0, 1.0),
        ("2019-11-18", "gone", 1.0, 1.0), ("2019-11-18", "t1", 1.0, 1.0), ("2020-11-16", "t1", 2.0, 1.0),
        ("2019-11-18", "t0", 1.0, 1.0), ("2020-11-16", "t0", 2.0, 1.0), ("2019-11-18", "z", 0.0, 0.0),
        ("2020-11-16", "z", 2.0, 1.0)]
    df = frame([(d, "m", c[0], c, f"n{c}", p, t) for d, c, p, t in rows],
               "date date, fund_type string, category string, code string, name string, price double, total_value double")
    return returns.two_date_compare(df, "2019-11-18", "2020-11-16")


def test_two_dates(compared):
    rows = {r["code"]: r for r in as_dicts(compared)}
    assert set(rows) == {"a", "new", "t0", "t1", "z"}
    assert (rows["a"]["change_price_percentage"], rows["a"]["change_total_value_percentage"]) == (20.0, -50.0)
    assert rows["new"]["previous_price"] is None and rows["z"]["change_price_percentage"] is None


def test_rankings_put_missing_last_and_break_ties_by_code(compared):
    assert [r.code for r in movers.top_movers(compared, 3).collect()] == ["t0", "t1", "a"]
    assert [r.code for r in movers.bottom_movers(compared, 40).collect()] == ["a", "t0", "t1", "new", "z"]
    assert [(r.category, r.n) for r in movers.category_mix(movers.top_movers(compared, 3)).collect()] == [("t", 2), ("a", 1)]


def test_histogram_counts_add_up(frame):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice([rng.random(), None])) for _ in range(500)]
    out = as_dicts(histogram.histogram(frame(rows, "f string, v double"), "v", "f", 50))
    assert sum(r["count"] for r in out) == sum(v is not None for _, v in rows)
    assert {r["bin"] for r in out} <= set(range(50)) and max(r["bin"] for r in out) == 49


def test_histogram_of_equal_values(frame):
    assert as_dicts(histogram.histogram(frame([("x", 2.0), ("x", 2.0)], "f string, v double"), "v", "f")) == [
        {"f": "x", "bin": 0, "count": 2}]


def test_valuation_rounds_money_half_up(frame):
    df = frame([("2020-11-16", 285000.0), ("2020-11-16", 25000000.0), ("2020-11-15", 1.0)], "date date, total_value double")
    rows = as_dicts(histogram.valuation_snapshot(df, "2020-11-16").orderBy("total_value"))
    assert [(r["total_value_millions"], r["total_value_bins"]) for r in rows] == [(0.29, 0), (25.0, 2)]


def test_month_close_keeps_the_last_row_even_if_missing(frame):
    df = frame([("a", "2020-01-05", 1.0, "x", 5.0), ("a", "2020-01-31", None, "y", 6.0), ("a", "2020-02-03", 3.0, "z", 7.0)],
               "code string, date date, price double, name string, p_Stock double")
    rows = as_dicts(monthly.monthly_close(df).orderBy("date"))
    assert [(r["year"], r["month"], r["price"], r["name"], str(r["date"]), str(r["data_date"])) for r in rows] == [
        (2020, 1, None, "y", "2020-01-01", "2020-01-31"), (2020, 2, 3.0, "z", "2020-02-01", "2020-02-03")]
    assert "p_Stock" not in rows[0]


def test_in_months(frame):
    df = frame([("2020-01-31",), ("2020-02-01",), ("2020-02-29",), ("2020-03-01",), ("2020-04-30",)], "date date")
    kept = [str(r.date) for r in monthly.in_months(df, "2020-02-01", "2020-04-01").collect()]
    assert kept == ["2020-02-01", "2020-02-29", "2020-04-30"]


def test_month_end_skips_missing_values(frame):
    df = frame([("b_x", "2020-01-05", 1.0), ("b_x", "2020-01-31", None), (None, None, 3.0)], "name string, date date, price double")
    assert [(r.price, str(r.data_date)) for r in monthly.month_end(df).collect()] == [(1.0, "2020-01-05")]


@pytest.fixture
def wide(frame):
    long = [(f"2020-{m:02}-01", n, float(m * 10 + i)) for m in range(1, 7) for i, n in enumerate(("b_usd", "b_gold"))
            if (m, n) != (3, "b_gold")]
    return benchmark.benchmark_wide(
        frame(long, "date date, name string, price double"), ("b_usd", "b_gold"), "2020-02-01", 2)


def test_wide_benchmarks_drop_the_last_months(wide):
    rows = as_dicts(wide.orderBy("date"))
    assert [(str(r["date"]), r["b_usd"], r["b_gold"]) for r in rows] == [
        ("2020-02-01", 20.0, 21.0), ("2020-03-01", 30.0, None), ("2020-04-01", 40.0, 41.0)]


def test_long_benchmarks_join_the_panel_by_name(frame, wide):
    long = benchmark.benchmark_long(wide, ("b_usd", "b_gold"))
    assert long.count() == 3 * 2
    both = benchmark.panel_with_benchmarks(
        frame([("a", "m", "2020-02-01", 1.0, 9.0)], "code string, fund_type string, date date, price double, shares double"), long)
    assert both.count() == 7
    assert both.filter("fund_type = 'benchmark' AND shares IS NULL AND NOT OKS AND code = name").count() == 6


def test_rebased(wide):
    rows = as_dicts(benchmark.benchmark_rebased(wide, {"usd": ("b_usd", 8.0), "gold": ("b_gold", 1.0)}, ("usd",)))
    assert {(str(r["date"]), r["category"], r["points"]) for r in rows} == {
        ("2020-02-01", "usd", 2.5), ("2020-03-01", "usd", 3.75), ("2020-04-01", "usd", 5.0)}


MONTHLY = ("code string, name string, fund_type string, category string, company_name string, company_code string, "
           "data_date date, year int, month int, price double, total_value double, shares double")


def month_rows(code, *points):
    return [(code, code, "m", "x", "co", "1", day, int(day[:4]), int(day[5:7]), price, 1.0, 1.0) for day, price in points]


def test_shift_joins_the_next_month(frame, wide):
    df = frame(month_rows("a", ("2020-01-31", 1.0), ("2020-02-28", 2.0), ("2020-03-31", 3.0), ("2020-12-31", 4.0)), MONTHLY)
    shifted = {str(r.date): r.b_usd for r in benchmark.panel_join_benchmark(df, wide).collect()}
    assert shifted == {"2020-01-31": 20.0, "2020-02-28": 30.0, "2020-03-31": 40.0}
    plain = {str(r.date): r.b_usd for r in benchmark.panel_join_benchmark(df, wide, shift_days=0).collect()}
    assert plain == {"2020-01-31": None, "2020-02-28": 20.0, "2020-03-31": 30.0}


def test_two_benchmark_rows_for_a_month_are_refused(frame, wide):
    doubled = wide.unionByName(wide.withColumn("date", F.date_add("date", 3)))
    with pytest.raises(PySparkException, match="two benchmark rows"):
        benchmark.by_shifted_month(doubled).collect()


COHORT = ("code string, name string, fund_type string, category string, company_name string, company_code string, "
          "date date, year int, month int, price double, total_value double, shares double, "
          "b_usd double, b_gold double, b_xu100 double")


@pytest.fixture
def index(frame):
    def rows(code, category, *points):
        return [(code, code, "m", category, "co", "1", day, int(day[:4]), int(day[5:7]), price, 1.0, 1.0, usd, usd, usd)
                for day, price, usd in points]

    return cohort.cohort_index(frame(
        rows("win", "x", ("2018-01-31", 9.0, 1.0), ("2018-03-30", 10.0, 2.0), ("2020-09-30", 30.0, 4.0))
        + rows("loss", "x", ("2018-01-31", 9.0, 1.0), ("2018-03-30", 10.0, 2.0), ("2020-09-30", 5.0, 4.0))
        + rows("slow", "y", ("2018-01-31", 9.0, 1.0), ("2018-03-30", 10.0, 2.0), ("2020-09-30", 15.0, 4.0))
        + rows("open", "y", ("2018-01-31", 9.0, 1.0), ("2018-03-30", 10.0, None), ("2020-09-30", 15.0, 4.0))
        + rows("young", "y", ("2018-02-28", 9.0, 1.0), ("2018-03-30", 10.0, 2.0), ("2020-09-30", 90.0, 4.0)), COHORT))


def test_cohort_is_indexed_to_its_first_row(index):
    rows = as_dicts(index)
    assert {r["code"] for r in rows} == {"win", "loss", "slow", "open"}
    assert all(r["price_indexed"] == 1.0 for r in rows if r["counter"] == 1)
    assert {r["code"]: r["price_indexed"] for r in rows if r["counter"] == 2} == {
        "win": 3.0, "loss": 0.5, "slow": 1.5, "open": 1.5}


def test_profit_classes(index):
    classed = cohort.profit_class(cohort.relative_performance(index))
    assert {r["code"]: r["profit"] for r in as_dicts(classed)} == {
        "win": cohort.EXCELLENT, "loss": cohort.LOSS, "slow": cohort.BEHIND, "open": None}
    counts = [(r.category, r.profit, r.n) for r in cohort.profit_counts(classed).collect()]
    assert counts == [("x", cohort.EXCELLENT, 1), ("x", cohort.LOSS, 1), ("y", cohort.BEHIND, 1)]


def test_best_with_and_without_the_first(index):
    performance = cohort.relative_performance(index)
    assert [r.code for r in cohort.best_k(performance, 50).collect()] == ["win", "open", "slow", "loss"]
    runners_up = cohort.best_k(performance, 2, skip=1)
    assert [r.code for r in runners_up.collect()] == ["open", "slow"]
    assert cohort.series_of(index, runners_up).count() == 4


RETURNS = ("code string, name string, fund_type string, category string, company_name string, OKS boolean, "
           "contribution boolean, participation boolean, date date, price double")


def months(code, kind, prices, oks=False, category="x"):
    return [(code, code, kind, category, "co", oks, False, False, f"2020-{m:02}-01", p) for m, p in enumerate(prices, 1)]


@pytest.fixture
def monthly_returns(frame):
    return returns.monthly_returns(frame(
        months("a", "mutual", [1.0, 2.0, 3.0]) + months("b", "mutual", [1.0, 1.0, 2.0], oks=True, category="y")
        + months("b_usd", "benchmark", [1.0, 1.5, 3.0]) + months("b_gold", "benchmark", [1.0, 5.0, 5.0]), RETURNS))


def test_growth_of_one_fund_leads_to_its_last_price(monthly_returns):
    q = compare.Comparison("2020-01-01", "2020-12-31", ("name",), funds=("a",))
    rows = as_dicts(compare.compare(monthly_returns, q).orderBy("date"))
    assert [r["growth_rate"] for r in rows] == [1.0, 2.0, 3.0]


def test_missing_returns_are_zero_or_dropped(monthly_returns):
    zero = compare.Comparison("2020-01-01", "2020-12-31", ("fund_type",), ("mutual",))
    drop = compare.Comparison("2020-01-01", "2020-12-31", ("fund_type",), ("mutual",), missing="drop")
    assert [r["avg_monthly_gain"] for r in as_dicts(compare.compare(monthly_returns, zero).orderBy("date"))] == [0.0, 0.5, 0.75]
    assert [r["avg_monthly_gain"] for r in as_dicts(compare.compare(monthly_returns, drop).orderBy("date"))] == [0.5, 0.75]


def test_filters_and_benchmarks(monthly_returns):
    q = compare.Comparison("2020-02-01", "2020-02-01", ("name",), benchmarks=("b_usd",), OKS=(False,))
    assert {r["name"] for r in as_dicts(compare.compare(monthly_returns, q))} == {"a", "b_usd"}
    q = compare.Comparison("2020-02-01", "2020-02-01", ("name",), benchmarks=(), categories=("y", "ALL"))
    assert {r["name"] for r in as_dicts(compare.compare(monthly_returns, q))} == {"a", "b"}


def test_risk_without_groups(monthly_returns):
    q = compare.Comparison("2020-01-01", "2020-12-31", (), ("mutual",))
    rows = as_dicts(compare.compare(monthly_returns, q, "stdev").orderBy("date"))
    gains = [0.0, 0.5, 0.75]
    assert [r["stdev"] for r in rows] == [pytest.approx(statistics.pstdev(gains[:i])) for i in (1, 2, 3)]


def test_parameters_are_checked(monthly_returns):
    with pytest.raises(ValueError):
        compare.Comparison(group_by=("price",))
    with pytest.raises(ValueError):
        compare.Comparison(missing="keep")
    with pytest.raises(ValueError):
        compare.compare(monthly_returns, compare.Comparison(), "eval(x)")


def test_choices_start_with_all_and_missing(frame):
    df = frame([("b",), ("a",), (None,), ("a",)], "category string")
    assert [r.choice for r in compare.choices(df, "category").collect()] == ["ALL", None, "a", "b"]


def test_choices_cascade(monthly_returns):
    q = compare.Comparison(fund_types=("mutual",), categories=("y",))
    assert [r.choice for r in compare.choices(monthly_returns, "name", q).collect()] == ["ALL", "b"]
    assert [r.choice for r in compare.choices(monthly_returns, "category", q).collect()] == ["ALL", "x", "y"]


def test_fill_forward_carries_over_pieces(frame):
    rng = random.Random(5)
    rows = [(s, i // 7, i, rng.choice([None, None, None, str(i)])) for s in "pq" for i in range(100)]
    expected, last = {}, {}
    for s, _, i, v in rows:
        last[s] = v if v is not None else last.get(s)
        expected[s, i] = last[s]
    out = fill_forward(frame(rows, "s string, piece int, line int, v string"), "v", ["s"], "piece", "line")
    assert {(r.s, r.line): r.v for r in out.collect()} == expected
