"""Consolidation, quality, flags, companies and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.text import latin_ascii
from panelmill.operators import companies as co
from panelmill.operators import coverage, flags, quality
from panelmill.operators.consolidate import consolidate_daily
from panelmill.plans.common import Entry, with_views
from panelmill.plans.views import (
    ASSETS, ENTITIES_SQL, FUND_DAILY_SQL, RAW_QUOTES_SQL, allocations, entities, fund_daily, raw_quotes, table,
)

EXCLUDED = ("0",)
FLAG_TESTS = {
    "OKS": {"name": "small "},
    "participation": {"name": "cold ", "category": "STANDARD"},
    "contribution": {"name": "^hot ", "category": "PROMO"},
}


def _consolidate(spark: SparkSession, d: str) -> DataFrame:
    panel = fund_daily(spark, d)
    prices = panel.select("date", "code", "name", "price", "shares", "people", "total_value", "fund_type")
    return consolidate_daily(prices, allocations(spark, d), entities(spark, d).select("code", "category"))


_ASSET_TOTAL = " + ".join(f'COALESCE("{a}", 0)' for a in ASSETS)
_CONSOLIDATE = with_views(
    "SELECT date, code, fund_type, e.category, p.name, price, shares, people, total_value, "
    + ", ".join(f"p_{a}" for a in ASSETS) + """
FROM (SELECT date, code, name, fund_type, price, shares, people, total_value FROM fund_daily) p
FULL OUTER JOIN alloc USING (date, code, fund_type) LEFT JOIN entities e USING (code)""",
    FUND_DAILY_SQL,
    "wide AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, "
    + ", ".join(
        f"CAST(SUM(CASE WHEN p_type = '{a}' THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS \"{a}\""
        for a in ASSETS)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2)",
    "alloc AS (SELECT date, code, fund_type, "
    + ", ".join(f'CAST("{a}" * 100 AS DOUBLE) / NULLIF({_ASSET_TOTAL}, 0) AS p_{a}' for a in ASSETS)
    + " FROM wide JOIN entities USING (code))")

_RULES = """ruled AS (SELECT *, CASE WHEN code IS NULL OR code = '0' THEN 1 WHEN name IS NULL THEN 2
    WHEN NOT COALESCE(price > 0 AND shares > 0, FALSE) THEN 3 END AS failed FROM raw_quotes),
active AS (SELECT DISTINCT code FROM ruled WHERE failed IS NULL
    AND date = (SELECT max(date) FROM ruled WHERE failed IS NULL)),
final AS (SELECT *, COALESCE(failed, CASE WHEN code NOT IN (SELECT code FROM active) THEN 4 END) AS rule FROM ruled)"""

_FUNNEL = with_views("""SELECT CAST(s.step AS INTEGER) AS step, s.rule,
  (SELECT COUNT(*) FROM final f WHERE f.rule = s.step) AS rows_rejected,
  (SELECT COUNT(*) FROM final f WHERE COALESCE(f.rule, 9) > s.step) AS rows_left,
  (SELECT COUNT(DISTINCT code) FROM final f WHERE COALESCE(f.rule, 9) > s.step) AS codes_left
FROM (VALUES (0, 'input'), (1, 'excluded_code'), (2, 'missing_name'), (3, 'no_price_or_shares'), (4, 'inactive'))
  AS s(step, rule)""", RAW_QUOTES_SQL, _RULES)

_PROFILE = with_views("""SELECT COUNT(*) AS rows, COUNT(DISTINCT code) AS codes,
  COUNT(*) FILTER (code IS NULL) AS null_code, COUNT(*) FILTER (name IS NULL) AS null_name,
  COUNT(*) FILTER (price IS NULL) AS null_price, COUNT(*) FILTER (shares IS NULL) AS null_shares,
  COUNT(*) FILTER (date IS NULL) AS null_date, COUNT(*) FILTER (category IS NULL) AS null_category,
  COUNT(*) FILTER (price IS NULL OR shares IS NULL OR price = 0 OR shares = 0) AS zero_or_missing,
  (SELECT COUNT(*) FROM (SELECT code FROM raw_quotes GROUP BY code HAVING COUNT(DISTINCT name) > 1))
    AS codes_with_two_names
FROM raw_quotes""", RAW_QUOTES_SQL)

_INACTIVE = with_views("""SELECT code, fund_type, category, COUNT(*) AS count, max(date) AS latest,
  min(date) AS earliest, CAST(max(date) - min(date) AS INTEGER) AS length
FROM fund_daily WHERE code NOT IN (SELECT code FROM fund_daily WHERE date = (SELECT max(date) FROM fund_daily))
GROUP BY code, fund_type, category""", FUND_DAILY_SQL)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))


_FLAGGED = """SELECT p_partkey AS code, p_name AS name, p_type AS category,
  COALESCE(regexp_matches(p_name, 'small '), FALSE) AS OKS,
  COALESCE(regexp_matches(p_name, 'cold '), FALSE) OR COALESCE(regexp_matches(p_type, 'STANDARD'), FALSE) AS participation,
  COALESCE(regexp_matches(p_name, '^hot '), FALSE) OR COALESCE(regexp_matches(p_type, 'PROMO'), FALSE) AS contribution
FROM part"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return parts.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name")))


_PREFIXES = """SELECT CAST(i AS INTEGER) AS length, COUNT(DISTINCT substring(name, 1, CAST(i AS INTEGER))) AS prefixes
FROM (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer), range(1, 26) r(i) GROUP BY i"""

# Company names carry a suffix in Turkish letters; those of one region start differently from the fund names.
_OVERRIDES = tuple(
    co.Override(f"^{n} ?$", f"E{i}", f"{n} EUROPE", "override")
    for i, n in enumerate(("NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23")))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    home = F.when(F.col("r_name") == "EUROPE", F.concat_ws(" ", "r_name", "n_name")).otherwise(F.col("n_name"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("company_code"),
        F.concat(home, F.lit(" Portföy Yönetimi A.Ş.")).alias("company_name"), F.col("r_name").alias("company_type"))


def _named_funds(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("code", F.concat_ws(" ", "category", "name", F.lit("FON İ")).alias("name"))


def _conform(spark: SparkSession, d: str) -> DataFrame:
    return co.conform_companies(
        _companies(spark, d), _named_funds(spark, d), dropped=("C4", "C9"), recoded={"C14": "CX"}, overrides=_OVERRIDES)


def _attach(spark: SparkSession, d: str) -> DataFrame:
    return co.attach_company(_named_funds(spark, d), _conform(spark, d))


def _override_sql(part: int, column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(name_start, '{o.pattern}') THEN '{o[part]}'" for o in reversed(_OVERRIDES))
    return f"CASE {cases} ELSE {column} END AS {column}"


_CONFORM_VIEWS = (ENTITIES_SQL, """funds AS (
  SELECT code, CONCAT(category, ' ', name, ' FON I') AS name FROM entities),
starts AS (SELECT DISTINCT substring(name, 1, 9) AS name_start FROM funds),
listed AS (
  SELECT CASE n_nationkey WHEN 14 THEN 'CX' ELSE CONCAT('C', CAST(n_nationkey AS VARCHAR)) END AS company_code,
    CONCAT(CASE WHEN r_name = 'EUROPE' THEN CONCAT(r_name, ' ', n_name) ELSE n_name END, ' Portfoy Yonetimi A.S.')
      AS company_name, r_name AS company_type
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (4, 9)),
conformed AS (SELECT name_start, """ + ", ".join(
    _override_sql(i, c) for i, c in ((1, "company_code"), (2, "company_name"), (3, "company_type"))) + """
  FROM starts FULL OUTER JOIN (SELECT *, substring(company_name, 1, 9) AS name_start FROM listed) USING (name_start))""")


def _ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", latin_ascii(F.col("text")).alias("text"))


# Independent of the library's table: accents by DuckDB's own function, the rest of the four languages by hand.
_ASCII = """SELECT doc_id, lang, replace(replace(replace(replace(replace(replace(replace(strip_accents(text),
  'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'), '«', '<<'), '»', '>>') AS text FROM documents"""


def _company_list(spark: SparkSession, d: str) -> DataFrame:
    """Company list as read from a file: a nation is a company, its region the type, and five share a name."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
        "CAST(n_nationkey AS STRING) AS company_code", "concat('CO_', CAST(n_nationkey % 7 AS STRING)) AS company_name",
        "r_name AS company_type")


_COMPANY_LIST = """companies AS (SELECT CAST(n_nationkey AS VARCHAR) AS company_code,
  CONCAT('CO_', CAST(n_nationkey % 7 AS VARCHAR)) AS company_name, r_name AS company_type
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


QUERIES = {
    "consolidate_daily": Entry(_consolidate, _CONSOLIDATE),
    "dq_profile": Entry(lambda s, d: quality.dq_profile(raw_quotes(s, d)), _PROFILE),
    "duplicate_keys": Entry(
        lambda s, d: quality.duplicate_keys(raw_quotes(s, d), ["code", "date"]),
        with_views("SELECT code, date, COUNT(*) AS count FROM raw_quotes GROUP BY code, date HAVING COUNT(*) > 1",
                   RAW_QUOTES_SQL)),
    "names_per_code": Entry(
        lambda s, d: quality.names_per_code(raw_quotes(s, d)),
        with_views("SELECT code, COUNT(DISTINCT name) AS names FROM raw_quotes GROUP BY code "
                   "HAVING COUNT(DISTINCT name) > 1", RAW_QUOTES_SQL)),
    "clean_panel": Entry(
        lambda s, d: quality.clean_panel(raw_quotes(s, d), EXCLUDED),
        with_views("SELECT date, code, name, category, price, shares FROM final WHERE rule IS NULL",
                   RAW_QUOTES_SQL, _RULES)),
    "cleaning_funnel": Entry(lambda s, d: quality.cleaning_funnel(raw_quotes(s, d), EXCLUDED), _FUNNEL),
    "inactive_entities": Entry(lambda s, d: quality.inactive_entities(fund_daily(s, d)), _INACTIVE),
    "inactive_rows": Entry(
        lambda s, d: quality.inactive_rows(fund_daily(s, d).select("date", "code", "price", "total_value")),
        with_views("""SELECT date, code, price, total_value FROM fund_daily WHERE code NOT IN (
          SELECT code FROM fund_daily WHERE date = (SELECT max(date) FROM fund_daily))""", FUND_DAILY_SQL)),
    "product_flags": Entry(lambda s, d: flags.product_flags(_parts(s, d), FLAG_TESTS), _FLAGGED),
    "flag_counts": Entry(
        lambda s, d: flags.flag_counts(_parts(s, d), FLAG_TESTS),
        with_views("""SELECT OKS, participation, contribution, COUNT(DISTINCT code) AS codes FROM flagged
          GROUP BY OKS, participation, contribution""", f"flagged AS ({_FLAGGED})")),
    "prefix_cardinality": Entry(lambda s, d: flags.prefix_cardinality(_names(s, d)), _PREFIXES),
    "conform_companies": Entry(
        _conform, with_views("SELECT name_start, company_code, company_name, company_type FROM conformed",
                             *_CONFORM_VIEWS)),
    "attach_company": Entry(
        _attach, with_views("""SELECT code, name, company_name, company_code FROM funds
          LEFT JOIN conformed ON name_start = substring(name, 1, 9)""", *_CONFORM_VIEWS)),
    "without_company": Entry(
        lambda s, d: co.without_company(_attach(s, d)),
        with_views("""SELECT code, name, company_name, company_code FROM funds
          LEFT JOIN conformed ON name_start = substring(name, 1, 9)
          WHERE company_name IS NULL OR company_code IS NULL""", *_CONFORM_VIEWS)),
    "latin_ascii_text": Entry(_ascii, _ASCII),
    "company_types": Entry(
        lambda s, d: coverage.entity_counts(_company_list(s, d), ["company_type"], "company_code"),
        with_views("SELECT company_type, COUNT(DISTINCT company_code) AS count FROM companies GROUP BY company_type", _COMPANY_LIST)),
    "company_name_repeats": Entry(
        lambda s, d: quality.duplicate_keys(_company_list(s, d), ["company_name"]),
        with_views("SELECT company_name, COUNT(*) AS count FROM companies GROUP BY company_name HAVING COUNT(*) > 1",
                   _COMPANY_LIST)),
}
