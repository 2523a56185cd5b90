"""Physical plans, and exact results when one key holds a third of all rows."""

from __future__ import annotations

import datetime as dt
import re
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import as_dicts, final_plan_of, plan_of
from panelmill.operators import companies, compare, coverage, flags, histogram, quality, returns
from panelmill.plans.catalog import CATALOG
from panelmill.plans.views import fund_daily

SF_DIR = "/root/testdata/sf0.001"


# Spark has no reader for workbooks, so the one query on them parses (and first writes) them in mapInArrow.
PARSES_FILES = {"consolidate_from_workbooks"}


@pytest.mark.parametrize("name", list(CATALOG))
def test_plans_hold_no_python_and_no_cross_join(spark, name):
    plan = plan_of(CATALOG[name].run(spark, SF_DIR))
    if name in PARSES_FILES:
        plan = plan.replace("MapInArrow", "")
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = plan_of(coverage.entity_coverage(fund_daily(spark, SF_DIR)))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in scan


def test_date_range_reaches_the_scan_and_stays_above_the_window(spark):
    plan = plan_of(returns.daily_change_stats(fund_daily(spark, SF_DIR), "1999-11-15", 30))
    assert "GreaterThanOrEqual(l_shipdate,1999-11-15T00:00)" in plan and "LessThan(l_shipdate,1999-11-15T00:00)" in plan
    lines = plan.splitlines()
    window = next(i for i, x in enumerate(lines) if "Window [" in x)
    assert any("Filter" in x and "1999-11-15" in x for x in lines[:window])


def test_anchor_months_reach_the_scan(spark):
    plan = plan_of(CATALOG["two_date_compare"].run(spark, SF_DIR))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    pushed = scan.partition("PushedFilters: ")[2]
    assert "Or(And(GreaterThanOrEqual(l_shipdate,1999-11-01T00:00)" in pushed
    assert "And(GreaterThanOrEqual(l_shipdate,2000-11-01T00:00),LessThan(l_shipdate,2000-12-01T00:00))" in pushed


@pytest.mark.parametrize("name", ["compare_growth", "compare_growth_filtered", "compare_risk", "compare_risk_overall"])
def test_both_dates_of_a_comparison_reach_every_scan_of_the_lines(spark, name):
    scans = [x for x in plan_of(CATALOG[name].run(spark, SF_DIR)).splitlines() if "lineitem.parquet" in x]
    recent = [x for x in scans if "GreaterThanOrEqual(l_shipdate,1999-11-01T00:00)" in x and "LessThan(l_shipdate,2000-12-01T00:00)" in x]
    older = [x for x in scans if "LessThan(l_shipdate,1999-11-01T00:00)" in x]
    assert recent and older and len(recent) + len(older) == len(scans)


@pytest.mark.parametrize("name", ["clean_panel", "inactive_rows"])
def test_cleaning_reads_the_table_twice(spark, name):
    plan = final_plan_of(CATALOG[name].run(spark, SF_DIR))
    assert plan.count("lineitem.parquet") == 2


def test_one_month_snapshots_read_one_month(spark):
    for name in ("valuation_snapshot", "valuation_hist", "investors_hist"):
        assert "1999-11-01" not in plan_of(CATALOG[name].run(spark, SF_DIR))


def test_counting_people_moves_one_row_per_order(spark):
    plan = plan_of(CATALOG["consolidate_daily"].run(spark, SF_DIR))
    assert re.search(r"Exchange hashpartitioning\(l_suppkey#\d+L, date#\d+, l_orderkey#\d+L", plan)


def test_top_k_does_not_sort_everything(spark):
    for name in ("top_movers", "bottom_movers", "best_k", "best_k_offset"):
        assert "TakeOrderedAndProject" in plan_of(CATALOG[name].run(spark, SF_DIR))


def test_lines_are_combined_before_the_shuffle(spark):
    plan = plan_of(CATALOG["entity_coverage"].run(spark, SF_DIR))
    assert re.search(r"Exchange hashpartitioning\(l_suppkey#\d+L, date#\d+.*\n.*HashAggregate", plan)


def test_large_dimension_is_shuffled_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        plan = plan_of(fund_daily(spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [code" in plan


def test_histogram_range_reuses_the_shuffle(spark):
    plan = final_plan_of(CATALOG["valuation_hist"].run(spark, SF_DIR))
    assert "ReusedExchange" in plan


def test_unpartitioned_windows_see_one_row_per_date(spark):
    for name in ("compare_risk_overall", "cleaning_funnel", "benchmark_wide"):
        lines = plan_of(CATALOG[name].run(spark, SF_DIR)).splitlines()
        single = [i for i, x in enumerate(lines) if "Exchange SinglePartition" in x]
        assert single and all("HashAggregate" in "".join(lines[i + 1:i + 3]) for i in single)


HOT_ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """Quotes of which one code holds a third; days repeat within it."""
    n = F.col("id")
    code = F.when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("c"), (n % 997).cast("string")))
    return spark.range(HOT_ROWS).select(
        code.alias("code"), F.concat(F.lit("Fund "), code).alias("name"),
        F.when(n % 2 == 0, "even").otherwise("odd").alias("category"), F.lit("m").alias("fund_type"),
        F.expr("date_add(DATE'2020-01-01', CAST(id % 365 AS INT))").alias("date"),
        F.when(n % 11 > 0, (n % 50).cast("double")).alias("price"), (n % 7).cast("double").alias("shares"))


def python_rows():
    for n in range(HOT_ROWS):
        code = "HOT" if n % 3 == 0 else f"c{n % 997}"
        yield (code, dt.date(2020, 1, 1) + dt.timedelta(n % 365), float(n % 50) if n % 11 else None, float(n % 7), n)


def test_profile_and_funnel_with_a_hot_code(hot):
    rows = list(python_rows())
    (profile,) = as_dicts(quality.dq_profile(hot))
    assert profile["rows"] == HOT_ROWS and profile["codes"] == len({r[0] for r in rows})
    assert profile["null_price"] == sum(r[2] is None for r in rows)
    assert profile["zero_or_missing"] == sum(not r[2] or not r[3] for r in rows)
    good = [r for r in rows if r[2] and r[3]]
    newest = max(r[1] for r in good)
    active = {r[0] for r in good if r[1] == newest}
    steps = as_dicts(quality.cleaning_funnel(hot))
    assert [s["rows_left"] for s in steps][3:] == [len(good), sum(r[0] in active for r in good)]
    assert quality.clean_panel(hot).count() == steps[-1]["rows_left"]


def test_coverage_with_a_hot_code(hot):
    rows = list(python_rows())
    got = {(r["code"], r["category"]): r["count"] for r in as_dicts(coverage.entity_coverage(hot))}
    expected: dict = {}
    for r in rows:
        key = (r[0], "even" if r[4] % 2 == 0 else "odd")
        expected[key] = expected.get(key, 0) + 1
    assert got == expected


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def low_skew_limits(spark):
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key in SKEW:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def hot_file(hot, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "quotes")
    hot.withColumn("name", F.concat("name", F.lit(" "), F.sha2(F.rand(1).cast("string"), 512))).repartition(
        8).write.parquet(path)
    return path


def test_skewed_semi_join_is_split(spark, hot_file, low_skew_limits):
    """The rows of a hot code spread over several tasks of the join, and none is lost."""
    quotes = spark.read.parquet(hot_file)
    clean = quality.clean_panel(quotes)
    assert "skew=true" in final_plan_of(clean)
    steps = as_dicts(quality.cleaning_funnel(quotes))
    assert clean.count() == steps[-1]["rows_left"] > 0


def test_skewed_company_join_is_split(spark, hot_file, low_skew_limits):
    panel = spark.read.parquet(hot_file)
    conformed = spark.createDataFrame(
        [("Fund HOT ", "H", "hot", "m"), ("Fund c1 0", "C", "c", "m")],
        "name_start string, company_code string, company_name string, company_type string")
    out = companies.attach_company(panel, conformed)
    assert "skew=true" in final_plan_of(out)
    assert out.count() == HOT_ROWS
    assert out.filter("company_code = 'H'").count() == HOT_ROWS // 3


def test_group_with_a_third_of_all_returns(spark):
    """The window of a comparison sees one row per month, whatever the group's size."""
    n = F.col("id")
    df = spark.range(30_000).select(
        F.when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("g"), (n % 97).cast("string"))).alias("category"),
        F.lit("m").alias("fund_type"), F.lit("co").alias("company_name"), n.cast("string").alias("name"),
        *[F.lit(False).alias(c) for c in ("OKS", "contribution", "participation")],
        F.expr("add_months(DATE'2020-01-01', CAST(id % 12 AS INT))").alias("date"),
        F.lit(0.5).alias("monthly_price_change"))
    out = compare.compare(df, compare.Comparison("2020-01-01", "2020-12-01", ("category",), ("m",)))
    hot = [r for r in as_dicts(out.orderBy("date")) if r["category"] == "HOT"]
    months = sorted({i % 12 for i in range(0, 30_000, 3)})
    assert [r["growth_rate"] for r in hot] == [pytest.approx(1.5 ** k) for k in range(1, len(months) + 1)]
    assert "partial_avg" in plan_of(out)


def test_prefixes_and_histogram_with_one_hot_value(spark):
    names = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "same name").otherwise(F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit("f").alias("f"))
    plain = ["same name" if i % 3 == 0 else str(i) for i in range(9_000)]
    got = {r.length: r.prefixes for r in flags.prefix_cardinality(names, longest=5).collect()}
    assert got == {k: len({x[:k] for x in plain}) for k in range(1, 6)}
    assert sum(r["count"] for r in as_dicts(histogram.histogram(names, "v", "f"))) == 9_000


def test_closes_are_ranked_before_entity_columns_join(spark):
    """What is sorted per month is the measures alone; the texts of the entities join the closes."""
    below = plan_of(CATALOG["monthly_close"].run(spark, SF_DIR)).partition("WindowGroupLimit")[2]
    assert "l_suppkey" in below and "Join [code" not in below


@pytest.mark.parametrize("name", ["monthly_close", "monthly_close_by_days"])
def test_closes_of_a_code_of_two_entities_are_refused(spark, tmp_path, name):
    for table in ("region", "nation", "lineitem"):
        shutil.copy(f"{SF_DIR}/{table}.parquet", tmp_path)
    suppliers = spark.read.parquet(f"{SF_DIR}/supplier.parquet")
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    assert CATALOG[name].run(spark, str(tmp_path)).count() == CATALOG[name].run(spark, SF_DIR).count() > 0
    suppliers.limit(1).write.mode("append").parquet(str(tmp_path / "supplier.parquet"))
    with pytest.raises(PySparkException, match="closing date"):
        CATALOG[name].run(spark, str(tmp_path)).collect()
