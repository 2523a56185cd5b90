"""Versioned tables, month closes by days, running measures by segments, picker indices."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts, plan_of
from panelmill.functions import windows
from panelmill.functions.text import latin_ascii
from panelmill.operators import compare, pickers
from panelmill.operators.monthly import monthly_close
from panelmill.operators.segments import running
from panelmill.plans import staged_queries
from panelmill.sources.closes import MonthCloses, closes_schema
from panelmill.sources.versioned import Conflict, VersionedTable

DDL = "date date, code string, price double"


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture
def staged(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "panel"), DDL)


@pytest.fixture
def panel(spark):
    return lambda *rows: spark.createDataFrame([(day(d), c, p) for d, c, p in rows], DDL)


def rows_of(df):
    return sorted(((r.date and r.date.isoformat()) or "", r.code, r.price) for r in df.collect())


def folders(table):
    return {p.folder for p in table.parts()}


def test_days_are_added_and_replaced(staged, panel):
    assert staged.versions() == [] and staged.read().count() == 0
    staged.replace_all(panel(("2020-01-01", "a", 1.0), ("2020-01-02", "a", 2.0), ("2020-02-01", "a", 3.0), (None, "x", 0.0)))
    before = folders(staged)
    assert len(before) == 3
    staged.add_days(panel(("2020-02-02", "a", 4.0), ("2020-01-02", "b", 9.0)))
    assert before < folders(staged) and len(folders(staged)) == 5  # only two days are written
    assert rows_of(staged.read()) == [("", "x", 0.0), ("2020-01-01", "a", 1.0), ("2020-01-02", "b", 9.0), ("2020-02-01", "a", 3.0), ("2020-02-02", "a", 4.0)]
    staged.add_days(panel(("2020-01-02", "c", 8.0), (None, "y", 1.0)))
    assert rows_of(staged.read("2020-01-02", "2020-01-31")) == [("2020-01-02", "c", 8.0)]
    assert rows_of(staged.read()) == [("", "y", 1.0), ("2020-01-01", "a", 1.0), ("2020-01-02", "c", 8.0), ("2020-02-01", "a", 3.0), ("2020-02-02", "a", 4.0)]
    kept = rows_of(staged.read())
    staged.fold()
    assert len(staged.parts()) == 3 and not any(p.hidden for p in staged.parts()) and rows_of(staged.read()) == kept
    version = staged.versions()[-1]
    assert staged.fold() == version  # nothing to do


def test_only_the_days_of_a_range_are_read(staged, panel):
    staged.replace_all(panel(*[(f"2020-{m:02}-{d:02}", "a", float(d)) for m in (1, 2, 3) for d in (1, 2, 3)]), unit="day")
    files = staged.read("2020-02-02", "2020-02-03").inputFiles()
    assert sorted({f.split("_part=")[1].split("/")[0] for f in files}) == ["2020-02-02", "2020-02-03"]
    assert staged.read("2021-01-01").count() == 0
    assert "PushedFilters: [IsNotNull(date)" in plan_of(staged.read("2020-02-02"))


def test_a_reader_keeps_its_version(staged, panel):
    first = staged.replace_all(panel(("2020-01-01", "a", 1.0)))
    pinned = staged.read()
    staged.add_days(panel(("2020-01-01", "a", 2.0), ("2020-01-02", "a", 3.0)))
    staged.replace_all(panel(("2021-01-01", "z", 0.0)))
    assert rows_of(pinned) == rows_of(staged.read(version=first)) == [("2020-01-01", "a", 1.0)]
    assert rows_of(staged.read(version=first + 1)) == [("2020-01-01", "a", 2.0), ("2020-01-02", "a", 3.0)]


def test_a_failed_write_changes_nothing(staged, panel):
    staged.replace_all(panel(("2020-01-01", "a", 1.0)))
    broken = panel(("2020-01-02", "a", 1.0), ("2020-01-03", "b", 2.0)).repartition(2).withColumn(
        "price", F.when(F.col("code") == "b", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("price")))
    for write in (staged.add_days, staged.replace_all, staged.append):
        with pytest.raises(Exception, match="broken"):
            write(broken)
    assert staged.versions() == [1] and rows_of(staged.read()) == [("2020-01-01", "a", 1.0)]
    staged.add_days(panel(("2020-01-02", "a", 5.0)))
    staged._write(panel(("2020-01-09", "dead", 1.0)), "day", 3)  # a writer that died before its commit
    assert staged.vacuum(keep=1) >= 1 and len(staged._names("data")) == 2
    assert staged.versions() == [2] and rows_of(staged.read()) == [("2020-01-01", "a", 1.0), ("2020-01-02", "a", 5.0)]


def test_of_two_writers_one_wins(staged, panel):
    staged.replace_all(panel(("2020-01-01", "a", 1.0)))
    parts = staged._write(panel(("2020-01-02", "late", 1.0)), "day", 2)
    staged.add_days(panel(("2020-01-02", "first", 1.0)))
    with pytest.raises(Conflict):
        staged._commit(1, parts)
    assert rows_of(staged.read("2020-01-02")) == [("2020-01-02", "first", 1.0)]
    assert not [n for n in staged._names("_versions") if n.startswith("draft")]


def test_a_path_without_scheme(spark, tmp_path, panel):
    plain, full = VersionedTable(spark, str(tmp_path / "t"), DDL), VersionedTable(spark, f"file://{tmp_path}/t", DDL)
    plain.replace_all(panel(("2020-01-01", "a", 1.0)))
    assert rows_of(full.read()) == rows_of(plain.read()) and (Path(tmp_path) / "t" / "_versions").exists()


PANEL_DDL = "date date, code string, price double, category string"


@pytest.mark.parametrize("seed", range(2))
def test_closes_for_any_split_of_the_days(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(90)), f"c{rng.randrange(6)}") for _ in range(150)]
    rows = [(d, c, rng.random(), "x") for d, c in sorted(set(rows))]
    panel = spark.createDataFrame(rows, PANEL_DDL)
    closes = MonthCloses(spark, str(tmp_path / "closes"), closes_schema(panel))
    lots = [rng.randrange(4) for _ in rows]
    for lot in rng.sample(range(4), 4):
        closes.add(spark.createDataFrame([r for r, at in zip(rows, lots) if at == lot], PANEL_DDL))
    want = sorted(map(str, as_dicts(monthly_close(panel))))
    assert sorted(map(str, as_dicts(closes.read()))) == want
    closes.fold()
    assert sorted(map(str, as_dicts(closes.read()))) == want and closes.table.read().count() == len(want)


def test_only_changed_cells_are_written(spark, tmp_path):
    build = lambda *rows: spark.createDataFrame([(day(d), c, p, "x") for d, c, p in rows], PANEL_DDL)
    first = build(("2020-01-30", "a", 1.0), ("2020-01-20", "b", 2.0), ("2020-02-05", "a", 3.0))
    closes = MonthCloses(spark, str(tmp_path / "closes"), closes_schema(first))
    closes.add(first)
    closes.add(build(("2020-01-25", "a", 8.0), ("2020-01-25", "b", 9.0)))  # older for a, later for b
    written = [p for p in closes.table.parts() if p.write == 2]
    assert [(p.first, p.last) for p in written] == [("2020-01-01", "2020-01-31")]
    assert [(r.code, r.price) for r in closes.table._rows(written).collect()] == [("b", 9.0)]
    closes.add(build(("2020-01-30", "a", 7.0)))  # the closing day again
    assert {(r.code, r.month): r.price for r in closes.read().collect()} == {("a", 1): 7.0, ("b", 1): 9.0, ("a", 2): 3.0}
    assert closes.add(first.limit(0)) == 3
    with pytest.raises(Exception, match="more than one row on a closing date"):
        closes.add(build(("2020-03-01", "a", 1.0), ("2020-03-01", "a", 2.0)))
    assert closes.table.versions()[-1] == 3


SERIES = [("a", f"2020-{m:02}-{d:02}", None if (m + d) % 7 == 0 else (m * d % 5 - 2) / 10) for m in range(1, 13) for d in (1, 9, 17, 25)]
SERIES += [("b", "2020-05-05", 0.1), (None, "2020-03-03", 0.2), (None, "2020-09-09", -0.1), ("c", "2020-01-01", None), ("c", "2020-07-01", None)]


@pytest.mark.parametrize("segment", ["year(date)", "month(date)", "date", "date < '2020-06-01'"])
def test_segments_give_what_windows_give(spark, segment):
    df = spark.createDataFrame([(c, day(d), g) for c, d, g in SERIES], "code string, date date, gain double").repartition(5)
    cut = F.expr(f"NOT ({segment})") if "<" in segment else F.expr(segment)
    got = running(df, ["code"], cut, number="n", previous={"before": "gain"}, indexed={"index": "gain"}, growth={"growth": "gain"}, risk={"risk": "gain"})
    want = df.withColumns({
        "n": windows.sequence_number(["code"]), "before": windows.previous(F.col("gain"), ["code"]),
        "index": windows.indexed(F.col("gain"), ["code"]), "growth": windows.cumulative_growth(F.col("gain"), ["code"]),
        "risk": windows.expanding_risk(F.col("gain"), ["code"])})

    def near(rows):
        return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    assert near(got.collect()) == near(want.collect())


def test_one_series_is_spread_over_tasks(spark):
    df = spark.range(0, 3650 * 4).selectExpr("'one' AS code", "date_add(DATE '1980-01-01', int(id)) AS date", "rand(1) - 0.5 AS gain")
    got = running(df, ["code"], F.year("date"), number="n", risk={"risk": "gain"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 14600 and max(sizes) < 14600 / 2
    last = got.orderBy(F.desc("date")).first()
    assert last.n == 14600 and abs(last.risk - df.agg(F.stddev_pop("gain")).first()[0]) < 1e-9


@pytest.mark.parametrize("rows, segment, message", [
    ([("a", "2020-01-01", 1.0), ("a", "2020-01-01", 2.0)], "year(date)", "two rows"),
    ([("a", None, 1.0)], "year(date)", "without date"),
    ([("a", "2020-01-01", 1.0), ("a", "2020-06-01", 1.0), ("a", "2020-12-01", 2.0)], "month(date) % 6", "overlap"),
])
def test_broken_series_are_refused(spark, rows, segment, message):
    df = spark.createDataFrame([(c, day(d), g) for c, d, g in rows], "code string, date date, gain double")
    with pytest.raises(Exception, match=message):
        running(df, ["code"], F.expr(segment), number="n").collect()


PICKED = [("mutual", "x", "co1", True, False, True, "f1"), ("mutual", "y", "co2", False, True, True, "f2"), ("pension", "x", None, True, True, True, "f3"),
          ("pension", None, "co1", False, False, False, "f4"), ("mutual", "x", "co1", True, False, True, "f1")]


@pytest.mark.parametrize("column", ["category", "company_name", "name", "fund_type"])
@pytest.mark.parametrize("q", [
    None, compare.Comparison(fund_types=("mutual",)), compare.Comparison(OKS=(True,), contribution=(False,)),
    compare.Comparison(fund_types=("pension",), categories=("x", "y"), companies=("co1",)), compare.Comparison(fund_types=("none",)),
])
def test_index_gives_what_the_rows_give(spark, tmp_path, column, q):
    rows = spark.createDataFrame(PICKED, "fund_type string, category string, company_name string, OKS boolean, contribution boolean, participation boolean, name string")
    numbered = pickers.numbered(rows.repartition(40))  # numbers far apart: many buckets
    numbered.write.parquet(str(tmp_path / "e"))
    index = pickers.bitmap_index(spark.read.parquet(str(tmp_path / "e")))
    assert [r.choice for r in pickers.choices(index, column, q).collect()] == [r.choice for r in compare.choices(rows, column, q).collect()]


def test_indexed_pickers_read_the_index_alone(spark):
    plan = plan_of(staged_queries.QUERIES["choices_fund_indexed"].run(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in plan and "l_suppkey" not in plan and "bitmap" in plan


def test_any_number_of_marks(spark):
    text = "a" + "́" * 12 + "b́e " + "́x é"
    got = spark.createDataFrame([(text,)], "t string").select(latin_ascii(F.col("t"))).first()[0]
    assert got == "abe ́x e"
