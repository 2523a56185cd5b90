"""Column expressions at their edges."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelmill.functions import dates, numeric, text, windows


def values(df, expression):
    return [r[0] for r in df.select(expression.alias("v")).collect()]


def test_ratios_of_zero_and_missing_are_missing(frame):
    df = frame([(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0)], "x double, p double")
    assert values(df, numeric.simple_return(F.col("x"), F.col("p"))) == [None, None, None, 0.5]
    assert values(df, numeric.percent_change(F.col("x"), F.col("p"))) == [None, None, None, 50.0]


def test_log_leaves_out_what_is_not_positive(frame):
    df = frame([(100.0,), (0.0,), (-1.0,), (None,)], "x double")
    assert values(df, numeric.log10_positive(F.col("x"))) == [2.0, None, None, None]


def test_histogram_bins_close_the_last_edge(frame):
    df = frame([(0.0,), (0.999,), (1.0,), (9.0,), (10.0,), (None,)], "x double")
    bins = numeric.histogram_bin(F.col("x"), F.lit(0.0), F.lit(10.0), 10)
    assert values(df, bins) == [0, 0, 1, 9, 9, None]
    assert values(df, numeric.histogram_bin(F.col("x"), F.lit(5.0), F.lit(5.0), 10))[:2] == [0, 0]


def test_classes_are_right_closed(frame):
    df = frame([(0,), (10,), (11,), (20,), (21,), (30,), (None,)], "x int")
    labels = numeric.equal_width_label(F.col("x"), F.lit(0), F.lit(30), ["s", "m", "l"])
    assert values(df, labels) == ["s", "s", "m", "m", "l", "l", None]
    assert values(df, numeric.equal_width_label(F.col("x"), F.lit(3), F.lit(3), ["s", "m", "l"]))[0] == "s"


def test_rebase_rounds_half_up(frame):
    df = frame([(0.285,), (None,)], "x double")
    assert values(df, numeric.rebase(F.col("x"), 1.0)) == [0.29, None]


def test_dates_that_do_not_fit_are_missing(frame):
    df = frame([("31-12-2019",), ("2019-12",), ("12-2019",), ("Kaynak: x",), (None,)], "t string")
    first = dt.date(2019, 12, 1)
    assert values(df, dates.parse_date(F.col("t"), dates.DAY_MONTH_YEAR)) == [dt.date(2019, 12, 31)] + [None] * 4
    assert values(df, dates.parse_date(F.col("t"), dates.YEAR_MONTH)) == [None, first, None, None, None]
    assert values(df, dates.parse_date(F.col("t"), dates.MONTH_YEAR)) == [None, None, first, None, None]


def test_timestamps_ignore_fractions(frame):
    df = frame([("2020-11-18T10:11:12.345",), ("2020-11-18T10:11:12",), ("soon",)], "t string")
    seen = dt.datetime(2020, 11, 18, 10, 11, 12)
    assert values(df, dates.parse_timestamp(F.col("t")).cast("timestamp_ntz")) == [seen, seen, None]


@pytest.mark.parametrize("given, plain", [
    ("İSTANBUL IŞIK ığüşöç", "ISTANBUL ISIK igusoc"),
    ("ZİRAAT HAYAT VE EMEKLİLİK A.Ş.", "ZIRAAT HAYAT VE EMEKLILIK A.S."),
    ("Straße Æsir œuvre", "Strasse AEsir oeuvre"),
    ("Łódź – “señor” l’été", 'Lodz - "senor" l\'ete'),
    ("plain 123", "plain 123"),
    (None, None),
])
def test_transliteration(frame, given, plain):
    assert values(frame([(given,)], "t string"), text.latin_ascii(F.col("t"))) == [plain]


def test_transliteration_table_is_one_to_one():
    source, target = text.ascii_table()
    assert len(source) == len(target) == len(set(source)) and target.isascii()


def test_missing_text_does_not_match(frame):
    df = frame([("A OKS B",), ("OKS",), (None,)], "t string")
    assert values(df, text.matches(F.col("t"), " OKS ")) == [True, False, False]


def test_growth_and_risk_over_time(frame):
    rows = [("a", "2020-01-01", 0.1), ("a", "2020-02-01", -1.5), ("a", "2020-03-01", 0.2), ("b", "2020-01-01", 1.0)]
    df = frame(rows, "k string, date date, g double")
    out = df.select(
        "k", "date", windows.cumulative_growth(F.col("g"), ["k"]).alias("growth"),
        windows.expanding_risk(F.col("g"), ["k"]).alias("risk")).orderBy("k", "date").collect()
    assert [round(r.growth, 9) for r in out] == [1.1, -0.55, -0.66, 2.0]
    assert [round(r.risk, 9) for r in out] == [
        0.0, 0.8, round(statistics.pstdev([0.1, -1.5, 0.2]), 9), 0.0]


def test_two_rows_on_one_date_are_refused(frame):
    df = frame([("a", "2020-01-01", 1.0), ("a", "2020-01-01", 2.0)], "code string, date date, price double")
    with pytest.raises(PySparkException, match="duplicate"):
        df.select(windows.previous(F.col("price"), ["code"])).collect()
