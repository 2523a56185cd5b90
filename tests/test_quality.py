"""Profile, rules, funnel, flags, companies and consolidation on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from conftest import as_dicts
from panelmill.operators import companies as co
from panelmill.operators import coverage, flags, quality
from panelmill.operators.consolidate import consolidate_daily

QUOTES = "date date, code string, name string, category string, price double, shares double"
ROWS = [
    ("2020-01-01", "FPR", "f", None, 1.0, 1.0),
    ("2020-01-01", "A", "a", "x", 1.0, 1.0),
    ("2020-01-02", "A", "a", "x", 0.0, 1.0),
    ("2020-01-03", "A", "a2", "x", 2.0, 1.0),
    ("2020-01-01", "B", None, "x", 1.0, 1.0),
    ("2020-01-02", "B", "b", "x", 1.0, None),
    ("2020-01-02", "B", "b", "x", 1.0, 5.0),
    ("2020-01-04", "B", "b", "x", None, 5.0),
    ("2020-01-02", "C", "c", None, -1.0, 5.0),
]


@pytest.fixture
def quotes(frame):
    return frame(ROWS, QUOTES)


def test_profile_is_one_row(quotes):
    (row,) = as_dicts(quality.dq_profile(quotes))
    assert row == {
        "rows": 9, "codes": 4, "null_code": 0, "null_name": 1, "null_price": 1, "null_shares": 1, "null_date": 0,
        "null_category": 2, "zero_or_missing": 3, "codes_with_two_names": 1}


def test_latest_date_counts_only_rows_that_pass(quotes):
    clean = quality.clean_panel(quotes)
    assert sorted((r.code, str(r.date)) for r in clean.collect()) == [("A", "2020-01-01"), ("A", "2020-01-03")]


def test_funnel_adds_up(quotes):
    steps = as_dicts(quality.cleaning_funnel(quotes))
    assert [s["rows_left"] for s in steps] == [9, 8, 7, 3, 2]
    assert [s["rows_rejected"] for s in steps] == [0, 1, 1, 4, 1]
    assert [s["codes_left"] for s in steps] == [4, 3, 3, 2, 1]
    assert steps[0]["rows_left"] == steps[-1]["rows_left"] + sum(s["rows_rejected"] for s in steps)
    assert steps[-1]["rows_left"] == quality.clean_panel(quotes).count()


def test_funnel_of_nothing(frame):
    assert [s["rows_left"] for s in as_dicts(quality.cleaning_funnel(frame([], QUOTES)))] == [0] * 5


def test_active_and_inactive_rows_make_the_whole(quotes):
    latest = quality.active_codes(quotes)
    active = quotes.join(latest, "code", "left_semi").count()
    assert active + quality.inactive_rows(quotes).count() == quotes.count()


def test_inactive_entities(frame):
    df = frame([("A", "m", "x", "2020-01-01"), ("A", "m", "x", "2020-01-05"), ("B", "m", "x", "2020-01-02"),
                ("C", "m", "x", "2020-01-01"), ("C", "m", "y", "2020-01-05")],
               "code string, fund_type string, category string, date date")
    rows = as_dicts(quality.inactive_entities(df))
    assert [(r["code"], r["count"], r["length"]) for r in rows] == [("B", 1, 0)]


def test_duplicates_and_names(quotes):
    assert [(r.code, r["count"]) for r in quality.duplicate_keys(quotes, ["code", "date"]).collect()] == [("B", 2)]
    assert [r.code for r in quality.names_per_code(quotes).collect()] == ["A"]


def test_flag_patterns_need_case_and_spaces(frame):
    df = frame([("1", "X OKS Y", None), ("2", "X oks Y", "a contribution b"), ("3", None, "OKS"), ("4", "A KATILIM B", "x")],
               "code string, name string, category string")
    rows = {r["code"]: (r["OKS"], r["participation"], r["contribution"]) for r in as_dicts(flags.product_flags(df))}
    assert rows == {"1": (True, False, False), "2": (False, False, True), "3": (False,) * 3, "4": (False, True, False)}
    assert sum(r["codes"] for r in as_dicts(flags.flag_counts(df))) == 4


def test_prefix_counts_never_fall(frame):
    df = frame([("alpha",), ("alpine",), ("beta",), ("alpha",), (None,)], "name string")
    counts = [r.prefixes for r in flags.prefix_cardinality(df, longest=6).collect()]
    assert counts == [3, 3, 3, 4, 4, 4]


def test_missing_code_counts_as_an_entity(frame):
    df = frame([("a", "x"), ("a", "x"), (None, "x"), (None, None)], "code string, fund_type string")
    assert coverage.entity_counts(df).first()["count"] == 2
    assert [(r.fund_type, r["count"]) for r in coverage.entity_counts(df, ["fund_type"]).collect()] == [
        ("x", 2), (None, 1)]


def test_single_day_has_no_coverage_and_sorts_last(frame):
    df = frame([("a", "m", "x", "2020-01-01"), ("b", "m", "x", "2020-01-01"), ("b", "m", "x", "2020-01-05")],
               "code string, fund_type string, category string, date date")
    assert [(r.code, r.coverage) for r in coverage.entity_coverage(df).collect()] == [("b", 0.5), ("a", None)]


COMPANIES = [
    ("ZEM", "TÜRKİYE HAYAT VE EMEKLİLİK A.Ş.", "pension"),
    ("VEM", "TÜRKİYE HAYAT VE EMEKLİLİK A.Ş.", "pension"),
    ("HEM", "TÜRKİYE HAYAT VE EMEKLİLİK A.Ş.", "pension"),
    ("AKP", "AK PORTFÖY YÖNETİMİ A.Ş.", "mutual"),
    ("ANM", "AEGON EMEKLİLİK VE HAYAT A.Ş.", "pension"),
]
FUNDS = [
    ("1", "TÜRKİYE HAYAT VE EMEKLİLİK HEM FONU"), ("2", "AK PORTFÖY BİST 30"), ("3", "AEGON  EMEKLİLİK FONU"),
    ("4", "BİLİNMEYEN FON"), ("5", None),
]


@pytest.fixture
def funds(frame):
    return frame(FUNDS, "code string, name string")


def test_companies_are_merged_matched_and_overridden(frame, funds):
    listed = frame(COMPANIES, "company_code string, company_name string, company_type string")
    conformed = co.conform_companies(listed, funds)
    matched = co.attach_company(funds, conformed)
    rows = {r["code"]: (r["company_code"], r["company_name"]) for r in as_dicts(matched)}
    assert rows["1"] == ("TEM", "TURKIYE HAYAT VE EMEKLILIK A.S.")
    assert rows["2"] == ("AKP", "AK PORTFOY YONETIMI A.S.")
    assert rows["3"] == ("ANM", "AEGON EMEKLILIK VE HAYAT A.S.")
    assert rows["4"] == rows["5"] == (None, None)
    assert matched.count() == funds.count()
    assert sorted(r.code for r in co.without_company(matched).collect()) == ["4", "5"]


def test_two_companies_for_a_matched_prefix_are_refused(frame, funds):
    listed = frame([*COMPANIES, ("AK2", "AK PORTFÖY İKİ", "mutual")],
                   "company_code string, company_name string, company_type string")
    with pytest.raises(PySparkException, match="more than one company"):
        co.attach_company(funds, co.conform_companies(listed, funds)).collect()


def test_consolidation_keeps_both_sides_and_matches_missing_keys(frame):
    prices = frame(
        [("2020-01-01", "A", "m", "a", 1.0), ("2020-01-02", "A", "m", "a", 2.0), (None, None, "m", "n", 3.0)],
        "date date, code string, fund_type string, name string, price double")
    shares = frame(
        [("2020-01-01", "A", "m", 50.0), ("2020-01-03", "B", "m", 60.0), (None, None, "m", 70.0)],
        "date date, code string, fund_type string, p_Stock double")
    categories = frame([("A", "x")], "code string, category string")
    out = consolidate_daily(prices, shares, categories)
    assert out.columns == ["date", "code", "fund_type", "category", "name", "price", "p_Stock"]
    rows = sorted(((str(r.date), r.code or "", r.category, r.name, r.price, r.p_Stock) for r in out.collect()))
    assert rows == [
        ("2020-01-01", "A", "x", "a", 1.0, 50.0), ("2020-01-02", "A", "x", "a", 2.0, None),
        ("2020-01-03", "B", None, None, None, 60.0), ("None", "", None, "n", 3.0, 70.0)]
