"""Ordered text rules as a table: joined by an index over short pieces of the patterns, never unrolled into a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.text import latin_ascii, prefix
from panelmill.operators.companies import DROPPED_CODES, PREFIX_LENGTH, RECODED, merge_company_codes
from panelmill.operators.flags import name_starts

RULES = "position INT, pattern STRING, whole BOOLEAN, company_code STRING, company_name STRING, company_type STRING"
GRAM = 3


def grams_of(text: Column, most: int = GRAM) -> Column:
    """The distinct pieces of 1 to ``most`` characters of a text."""
    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*(of(n) for n in range(1, most + 1))))


def first_matches(texts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """``column`` and struct ``rule``: for each distinct text with a match, the rule of the lowest position whose pattern
    (plain text, cases kept) lies in it, or is all of it but for blanks around it where the rule says ``whole``.

    A rule is found by the first ``GRAM`` characters of its pattern, so a text meets only rules whose beginning it has.
    Texts and patterns that are missing or empty match nothing. Two rules in one position go by pattern.
    """
    # indexed for itself, without fields that could clash with the texts' columns
    index = rules.filter(F.col("pattern") != "").select(
        F.substring("pattern", 1, GRAM).alias("_gram"),
        F.struct("position", "pattern", *(c for c in rules.columns if c not in ("position", "pattern"))).alias("_rule"))
    pieces = texts.filter(F.col(column) != "").select(column).distinct().withColumn("_gram", F.explode_outer(grams_of(F.col(column))))
    text, pattern = F.col(column), F.col("_rule.pattern")
    met = pieces.join(index, "_gram").filter(F.when(F.col("_rule.whole"), F.trim(text) == pattern).otherwise(F.contains(text, pattern)))
    return met.groupBy(column).agg(F.min("_rule").alias("rule"))


def conform_by_rules(companies: DataFrame, panel: DataFrame, rules: DataFrame, length: int = PREFIX_LENGTH,
                     dropped=DROPPED_CODES, recoded: dict[str, str] = RECODED) -> DataFrame:
    """As ``companies.conform_companies``, with the overrides in a table of ``RULES``, where the lowest position wins."""
    listed = merge_company_codes(companies, dropped, recoded).withColumn("company_name", latin_ascii(F.col("company_name")))
    listed = listed.withColumn("name_start", prefix(F.col("company_name"), length))
    names = panel.select("name").distinct().select(latin_ascii(F.col("name")).alias("name"))
    joined = name_starts(names, length).join(listed, "name_start", "full_outer")
    matched = joined.join(first_matches(joined, "name_start", rules), "name_start", "left")

    def overridden(c: str) -> Column:
        return F.when(F.col("rule").isNotNull(), F.col(f"rule.{c}")).otherwise(F.col(c)).alias(c)
    return matched.select("name_start", *(overridden(c) for c in ("company_code", "company_name", "company_type")))
