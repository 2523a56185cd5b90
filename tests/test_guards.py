"""Staged panel end to end, and inputs that must be refused or counted, whatever columns are read."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import as_dicts, plan_of
from panelmill import schema
from panelmill.functions.text import latin_ascii
from panelmill.operators import benchmark, cohort, companies, compare, monthly, quality, reshape, returns, stations
from panelmill.operators.consolidate import consolidate_daily
from panelmill.sources import files
from panelmill.sources.sizes import broadcast_if_small, broadcast_limit

DAILY = "code string, fund_type string, category string, name string, date date, price double, shares double, people double, total_value double"
ROWS = [
    ("a", "m", "x", "A", "2019-11-29", 1.0, 10.0, 3.0, 10.0), ("a", "m", "x", "A", "2019-12-30", 2.0, 10.0, 3.0, 20.0),
    ("a", "m", "x", "A", "2020-01-02", 3.0, 10.0, 3.0, 30.0), ("a", "m", "x", "A", "2020-01-31", 4.0, 10.0, 3.0, 40.0),
    ("b", "p", "y", "B", "2020-01-15", 5.0, 1.0, 1.0, 5.0), ("b", "p", "y", "B", "2020-02-28", 6.0, 1.0, 1.0, 6.0),
]


@pytest.fixture
def staged(frame, tmp_path):
    files.write_daily_panel(frame(ROWS, DAILY), str(tmp_path / "panel"))
    return str(tmp_path / "panel")


def test_staged_panel_by_date_range(spark, staged):
    panel = files.read_daily_panel(spark, staged, "2020-01-01", "2020-01-31")
    assert "PartitionFilters: [isnotnull(panel_year" in plan_of(panel)
    assert "panel_year" not in panel.columns and "year" not in panel.columns
    assert [f.dataType for f in panel.schema] == [f.dataType for f in schema.DAILY_PANEL]
    assert panel.count() == 3
    assert files.read_daily_panel(spark, staged).count() == len(ROWS)
    assert files.read_daily_panel(spark, staged, end="2019-12-30").count() == 2


def test_staged_panel_runs_through_the_library(spark, staged):
    panel = files.read_daily_panel(spark, staged, "2020-01-01")
    assert quality.clean_panel(panel, ()).count() == 2
    closes = monthly.monthly_close(panel)
    assert {(r.code, str(r.date), r.price) for r in closes.collect()} == {
        ("a", "2020-01-01", 4.0), ("b", "2020-01-01", 5.0), ("b", "2020-02-01", 6.0)}
    wide = spark.sql("SELECT DATE'2020-01-01' AS date, 7.0D AS b_usd UNION ALL SELECT DATE'2020-02-01', 8.0D")
    assert benchmark.panel_join_benchmark(
        closes.withColumns({"company_name": F.lit("c"), "company_code": F.lit("c")}), wide, before="2030-01-01").count() == 3
    marked = closes.withColumns({c: F.lit(True) for c in schema.FLAGS} | {"company_name": F.lit("c")})
    gains = returns.monthly_returns(marked, "2020-01-01", "2020-02-01")
    grown = compare.compare(gains, compare.Comparison("2020-01-01", "2020-02-01", ("name",), ("m", "p")), "growth_rate")
    assert {(r["name"], str(r["date"]), round(r["growth_rate"], 6)) for r in grown.collect()} == {
        ("A", "2020-01-01", 1.0), ("B", "2020-01-01", 1.0), ("B", "2020-02-01", 1.2)}


@pytest.mark.parametrize("bounds", [(None, None), ("2019-12-01", None), (None, "2020-01-01"), ("2019-12-01", "2020-01-01")])
def test_bounded_returns_are_those_of_the_whole_history(frame, bounds):
    closes = monthly.monthly_close(frame(ROWS, DAILY))
    start, end = bounds
    whole = returns.monthly_returns(closes)
    expected = whole.filter(F.col("date").between(start or "1900-01-01", end or "2900-01-01"))
    assert sorted(map(str, returns.monthly_returns(closes, start, end).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("setting", ["10m", "10MB", "10485760", "10485760b"])
def test_broadcast_limit_takes_every_form(spark, frame, tmp_path, setting):
    files.write_stage(frame([("a", 1)], "code string, n int"), str(tmp_path / "dim"))
    dim = files.read_stage(spark, str(tmp_path / "dim"))
    hinted = lambda: "strategy=broadcast" in broadcast_if_small(dim, dim)._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
    try:
        assert broadcast_limit(spark) == 10 << 20 and hinted()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert broadcast_limit(spark) < 0 and not hinted()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kept", [["price"], ["price", "name"]])
def test_closes_agree_on_missing_dates_and_refuse_ties(frame, kept):
    rows = frame([*ROWS, ("a", "m", "x", "A", None, 9.0, 1.0, 1.0, 1.0)], DAILY).select("code", "date", *kept)
    assert {(r.code, str(r.date)): r.price for r in monthly.monthly_close(rows).collect()} == {
        ("a", "2019-11-01"): 1.0, ("a", "2019-12-01"): 2.0, ("a", "2020-01-01"): 4.0, ("b", "2020-01-01"): 5.0, ("b", "2020-02-01"): 6.0}
    twice = rows.unionAll(rows.filter("code = 'b'"))
    with pytest.raises(PySparkException, match="closing date"):
        monthly.monthly_close(twice).count()


def refused(df, message, *others):
    """Whatever is read of the result, the error is raised."""
    for result in (df, *others):
        with pytest.raises(PySparkException, match=message):
            result.count()
    with pytest.raises(PySparkException, match=message):
        df.groupBy(df.columns[0]).count().collect()


def test_two_companies_are_refused_whatever_is_read(frame):
    dim = frame([("ABC", "c1", "One", "m"), ("ABC", "c2", "Two", "m")],
                "name_start string, company_code string, company_name string, company_type string")
    attached = companies.attach_company(frame([("f", "ABC")], "code string, name string"), dim, 3)
    refused(attached, "more than one company", attached.groupBy("company_name").count(), attached.select("code"))


@pytest.mark.parametrize("side", range(3))
def test_repeated_keys_are_refused_in_consolidation(frame, side):
    day = "2020-01-02"
    prices, shares, categories = [(day, "a", "m", "A", 1.0)], [(day, "a", "m", 50.0)], [("a", "x")]
    (prices, shares, categories)[side].append((prices, shares, categories)[side][0])
    result = consolidate_daily(
        frame(prices, "date date, code string, fund_type string, name string, price double"),
        frame(shares, "date date, code string, fund_type string, p_Stock double"), frame(categories, "code string, category string"))
    refused(result, "more than one (price row|allocation row|category)", result.select("price"))


def test_missing_keys_still_meet_in_consolidation(frame):
    result = consolidate_daily(
        frame([(None, "a", None, "A", 1.0)], "date date, code string, fund_type string, name string, price double"),
        frame([(None, "a", None, 50.0), ("2020-01-02", "", None, 1.0)], "date date, code string, fund_type string, p_Stock double"),
        frame([("a", "x")], "code string, category string"))
    assert {(r.code, r.category, r.price, r.p_Stock) for r in result.collect()} == {("a", "x", 1.0, 50.0), ("", None, None, 1.0)}


def test_repeated_date_before_the_period_is_refused(frame):
    rows = frame([("a", "2019-12-30", 1.0), ("a", "2019-12-30", 2.0), ("a", "2020-01-02", 3.0), ("a", "2020-01-03", 3.0)],
                 "code string, date date, price double")
    with pytest.raises(PySparkException, match="duplicate"):
        returns.daily_change_stats(rows, "2020-01-01", by=("code",)).collect()


def test_nan_is_missing(frame):
    rows = frame([("a", "A", float("nan"), 1.0, "2020-01-01", "x"), ("a", "A", 1.0, 1.0, "2020-01-01", "x")],
                 "code string, name string, price double, shares double, date date, category string")
    assert quality.clean_panel(rows, ()).count() == 1
    profile = as_dicts(quality.dq_profile(rows))[0]
    assert (profile["null_price"], profile["zero_or_missing"]) == (1, 1)
    assert [s["rows_rejected"] for s in as_dicts(quality.cleaning_funnel(rows, ()))] == [0, 0, 0, 1, 0]


def test_unreadable_cells_are_counted(spark, tmp_path):
    heads = ",".join(schema.PRICE_NAMES)
    path = tmp_path / "p.csv"
    path.write_text("\n".join([heads, "2020-01-02,A,Fund,1.5,1,1,1", "05.01.2020,A,Fund,1.5,1,1,1", "2020-01-03,A,Fund,oops,1,1,1"]), encoding="utf-8")
    sheets = {"mutual": str(path)}
    assert as_dicts(files.reject_counts(spark, sheets, schema.PRICE_SHEET)) == [{"fund_type": "mutual", "lines": 2}]
    assert files.read_prices(spark, sheets).count() == 3
    with pytest.raises(Exception, match="Malformed records"):
        files.read_prices(spark, sheets, mode="FAILFAST").collect()


def test_broken_documents_are_refused_or_found(frame):
    good = '{"dataList": [{"ID": "1"}, {"ID": "2"}]}'
    docs = frame([(good,), ('{"dataList": [{"ID"',), ('{"other": []}',), (None,), ('{"dataList": []}',)], "value string")
    with pytest.raises(PySparkException, match="no list 'dataList'"):
        stations.station_rows(docs).count()
    assert stations.unreadable_documents(docs).count() == 3
    assert stations.station_rows(stations.readable_documents(docs)).count() == 2


def test_unknown_names_are_refused_by_spread(frame):
    long = frame([("k", "a", 1.0), ("k", "z", 2.0)], "key string, name string, value double")
    refused(reshape.spread(long, ["key"], "name", "value", ["a"]), "unknown name: z")
    kept = frame([("k", "a", 1.0), ("l", None, 2.0)], "key string, name string, value double")
    assert {tuple(r) for r in reshape.spread(kept, ["key"], "name", "value", ["a"]).collect()} == {("k", 1.0), ("l", None)}


@pytest.mark.parametrize("text, plain", [
    ("e\u0301te\u0301", "ete"), ("A\u030a\u0301x", "Ax"), ("\u1e00\u1ef3 \u1e9e", "Ay SS"), ("«a…»", "<<a...>>"),
    ("İstanbul ığ ŞİŞLİ", "Istanbul ig SISLI"), ("日本\u0301", "日本\u0301"), ("plain", "plain"), (None, None)])
def test_transliteration(frame, text, plain):
    assert frame([(text,)], "t string").select(latin_ascii(F.col("t")).alias("t")).first()[0] == plain


def test_series_of_too_many_codes_is_refused(frame):
    index = frame([("a", 1.0), ("b", 2.0)], "code string, price double")
    assert cohort.series_of(index, index, 2).count() == 2
    with pytest.raises(PySparkException, match="to broadcast"):
        cohort.series_of(index, index, 1).count()


def test_bucketed_panel_has_a_place_and_a_key(spark, frame, tmp_path):
    df = frame([("a", "2020-01-02", 1.0)], "code string, date date, price double")
    files.write_bucketed_panel(df, "placed_panel", 2, str(tmp_path / "placed"))
    try:
        assert spark.table("placed_panel").count() == 1 and any((tmp_path / "placed").glob("*.parquet"))
        with pytest.raises(PySparkException, match="more than one row"):
            files.write_bucketed_panel(df.unionAll(df), "placed_twice", 2, str(tmp_path / "twice"))
    finally:
        spark.sql("DROP TABLE IF EXISTS placed_panel")
        spark.sql("DROP TABLE IF EXISTS placed_twice")
