"""Domain views over the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.guards import single
from panelmill.operators.monthly import in_months, month_end, monthly_close
from panelmill.operators.reshape import spread
from panelmill.sources.sizes import broadcast_if_small

ASSETS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SERIES = ("b_1", "b_2", "b_3", "b_4", "b_5")

# Declared, so that no job runs to infer them.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> str:
    """Money as whole cents: exact to add up, and a fixed-width aggregation buffer."""
    return f"CAST(round({amount} * 100) AS BIGINT)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per code with everything that depends on the code alone; broadcast while suppliers are few."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.expr("s_nationkey = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey"))
    return broadcast_if_small(joined.selectExpr(
        "CAST(s_suppkey AS STRING) AS code", "s_name AS name", "r_name AS fund_type", "n_name AS category",
        "CAST(n_nationkey AS STRING) AS company_code", "concat('CO_', CAST(n_nationkey % 7 AS STRING)) AS company_name",
        "s_acctbal < 2000 AS OKS", "s_acctbal >= 5000 AS participation",
        "s_acctbal BETWEEN 1000 AND 7000 AS contribution"), supplier)


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures per (code, date).

    Lines are reduced to that key first, with a map-side combine, so the joins and windows above see
    at most one row per calendar day and code, however many lines one supplier has.
    """
    return values_of(table(spark, sf_dir, "lineitem").withColumn("date", F.col("l_shipdate").cast("date")))


def values_of(lines: DataFrame) -> DataFrame:
    lines = lines.selectExpr("l_suppkey", "date", "l_quantity", "l_orderkey", f"{cents('l_extendedprice')} AS cents")
    return lines.groupBy("l_suppkey", "date").agg(
        F.expr("sum(cents) / 100D AS total_value"), F.expr("sum(l_quantity) AS shares"),
        F.expr("count(DISTINCT l_orderkey) AS people"),
    ).selectExpr(
        "CAST(l_suppkey AS STRING) AS code", "date", "try_divide(total_value, shares) AS price",
        "shares", "people", "total_value")


def fund_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel, one row per (code, date)."""
    return daily_values(spark, sf_dir).join(entities(spark, sf_dir), "code")


def with_entities(spark: SparkSession, sf_dir: str, closes: DataFrame) -> DataFrame:
    """Month closes of ``daily_values`` as those of ``fund_daily``: its columns and order, and a code of two entities,
    which has two rows on every closing date there, is an error."""
    known = entities(spark, sf_dir)
    counted = known.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("code")))
    joined = single(closes.join(counted, "code"), "_rows", "row on a closing date", "code", "data_date")
    return joined.select(*[c for c in closes.columns if c != "date"], *[c for c in known.columns if c != "code"], "date")


def fund_monthly(spark: SparkSession, sf_dir: str, *months: str) -> DataFrame:
    """Month closes, of the given months or all. Entity columns join the closes, not the days."""
    daily = daily_values(spark, sf_dir)
    closes = monthly_close(in_months(daily, *months) if months else daily)
    return closes.join(entities(spark, sf_dir), "code")


def fund_monthly_between(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """Month closes from ``start`` to ``end`` (first days of months), and each code's last close before ``start``.

    Both bounds reach the scan of the lines. Of the older lines only those of a code's last day leave the task that
    reads them; the history is neither shuffled nor grouped by day.
    """
    def lines() -> DataFrame:
        return table(spark, sf_dir, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))

    older = lines().filter(F.col("l_shipdate") < F.lit(start).cast("timestamp_ntz"))
    latest = Window.partitionBy("l_suppkey").orderBy(F.desc("date"))
    last = older.withColumn("_rank", F.rank().over(latest)).filter("_rank = 1")
    recent = lines().filter(
        (F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.add_months(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    rows = recent.unionAll(last.select(*recent.columns))
    return monthly_close(values_of(rows)).join(entities(spark, sf_dir), "code")


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each asset in a fund-day's value, in percent; returned lines are not in it."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    valued = lines.join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_suppkey", "CAST(l_shipdate AS DATE) AS date", "p_type", f"{cents('l_extendedprice')} AS cents")
    wide = spread(valued, ["date", "l_suppkey"], "p_type", "cents", ASSETS, combine=F.sum)
    total = " + ".join(f"coalesce({a}, 0)" for a in ASSETS)
    percent = [f"try_divide({a} * 100, {total}) AS p_{a}" for a in ASSETS]
    types = entities(spark, sf_dir).select("code", "fund_type")
    return wide.selectExpr("date", "CAST(l_suppkey AS STRING) AS code", *percent).join(types, "code").select(
        "date", "code", "fund_type", *[f"p_{a}" for a in ASSETS])


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level quotes with the faults a raw file has: missing, zero and renamed values."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_shipdate AS DATE) AS date", "CAST(l_suppkey AS STRING) AS code",
        """CASE WHEN l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08
             THEN concat('Fund ', CAST(l_suppkey AS STRING), ' B')
           WHEN l_discount > 0 THEN concat('Fund ', CAST(l_suppkey AS STRING)) END AS name""",
        "CASE WHEN l_quantity > 1 THEN l_linestatus END AS category",
        "CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price",
        "CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS shares")


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series, one per order priority; combined on the map side to one row per series and day."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderdate AS DATE) AS date", "concat('b_', substring(o_orderpriority, 1, 1)) AS name",
        f"{cents('o_totalprice')} AS cents")
    return rows.groupBy("date", "name").agg(F.expr("sum(cents) / 100D / count(1) AS price"))


def benchmark_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_end(benchmark_daily(spark, sf_dir))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per user: views are free places, clicks are places in use."""
    k = "try_cast(get_json_object(props, '$.k') AS INT)"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("STATION_NO")).agg(
        F.expr("count_if(event_type = 'view') AS EMPTY"), F.expr("count_if(event_type = 'click') AS FULL"),
        F.expr(f"min({k}) AS LAT"), F.expr(f"max({k}) AS LON"), F.expr("max(ts) AS LAST_CONNECTION"),
    ).selectExpr(
        "STATION_NO AS ID", "STATION_NO", "concat('Station ', CAST(STATION_NO AS STRING)) AS STATION_NAME",
        "1 AS ACTIVE", "EMPTY", "FULL", "LAT", "LON", "LAST_CONNECTION")


ENTITIES_SQL = """entities AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, r_name AS fund_type, n_name AS category,
    CAST(n_nationkey AS VARCHAR) AS company_code,
    CONCAT('CO_', CAST(n_nationkey % 7 AS VARCHAR)) AS company_name,
    s_acctbal < 2000 AS OKS, s_acctbal >= 5000 AS participation,
    s_acctbal BETWEEN 1000 AND 7000 AS contribution
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FUND_DAILY_SQL = ENTITIES_SQL + """, lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
    SUM(l_quantity) AS shares, COUNT(DISTINCT l_orderkey) AS people
  FROM lineitem GROUP BY 1, 2),
fund_daily AS (
  SELECT date, code, name, fund_type, category, company_code, company_name,
    total_value / NULLIF(shares, 0) AS price, shares, people, total_value, OKS, participation, contribution
  FROM lines JOIN entities USING (code))"""

FUND_MONTHLY_SQL = FUND_DAILY_SQL + """, fund_monthly AS (
  SELECT code, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
    max(date) AS data_date, max_by(name, date) AS name, max_by(fund_type, date) AS fund_type,
    max_by(category, date) AS category, max_by(company_code, date) AS company_code,
    max_by(company_name, date) AS company_name, max_by(price, date) AS price, max_by(shares, date) AS shares,
    max_by(people, date) AS people, max_by(total_value, date) AS total_value, max_by(OKS, date) AS OKS,
    max_by(participation, date) AS participation, max_by(contribution, date) AS contribution,
    make_date(year(date), month(date), 1) AS date
  FROM fund_daily GROUP BY code, year(date), month(date))"""

RAW_QUOTES_SQL = """raw_quotes AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS code,
    CASE WHEN l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08
           THEN CONCAT('Fund ', CAST(l_suppkey AS VARCHAR), ' B')
         WHEN l_discount > 0 THEN CONCAT('Fund ', CAST(l_suppkey AS VARCHAR)) END AS name,
    CASE WHEN l_quantity > 1 THEN l_linestatus END AS category,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price,
    CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS shares
  FROM lineitem)"""

BENCHMARK_DAILY_SQL = """benchmark_daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CONCAT('b_', SUBSTRING(o_orderpriority, 1, 1)) AS name,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price
  FROM orders GROUP BY 1, 2)"""

BENCHMARK_MONTHS_SQL = BENCHMARK_DAILY_SQL + """, benchmark_months AS (
  SELECT name, make_date(year(date), month(date), 1) AS date, max(date) AS data_date,
    max_by(price, date) AS price
  FROM benchmark_daily WHERE date IS NOT NULL AND price IS NOT NULL GROUP BY name, year(date), month(date))"""

STATIONS_SQL = """stations AS (
  SELECT user_id AS ID, user_id AS STATION_NO, CONCAT('Station ', CAST(user_id AS VARCHAR)) AS STATION_NAME,
    1 AS ACTIVE, COUNT(*) FILTER (event_type = 'view') AS EMPTY, COUNT(*) FILTER (event_type = 'click') AS "FULL",
    MIN(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS LAT,
    MAX(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS LON, MAX(ts) AS LAST_CONNECTION
  FROM events GROUP BY user_id)"""

Query = Callable[[SparkSession, str], DataFrame]
