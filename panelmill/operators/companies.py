"""Matching names to the company they start with."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.text import latin_ascii, matches, prefix
from panelmill.operators.flags import name_starts
from panelmill.operators.guards import single

# Merged companies, the code they go under, and the length of the matching prefix.
DROPPED_CODES = ("ZEM", "VEM")
RECODED = {"HEM": "TEM"}
PREFIX_LENGTH = 9


class Override(NamedTuple):
    """Company of every prefix that holds the pattern."""

    pattern: str
    code: str
    name: str
    kind: str


# Prefixes that differ from the official company name.
OVERRIDES = (
    Override("AEGON", "ANM", "AEGON EMEKLILIK VE HAYAT A.S.", "pension"),
    Override("AZIMUT", "GPO", "AZIMUT PORTFOY YONETIMI A.S.", "mutual"),
    Override("HSBC", "HPY", "HSBC PORTFOY YONETIMI A.S.", "mutual"),
    Override("CIGNA", "FEM", "CIGNA SAGLIK HAYAT VE EMEKLILIK A.S.", "pension"),
    Override("BEREKET", "ASH", "BEREKET EMEKLILIK VE HAYAT A.S.", "pension"),
)


def merge_company_codes(companies: DataFrame, dropped: Sequence[str] = DROPPED_CODES,
                        recoded: dict[str, str] = RECODED) -> DataFrame:
    """Company list without the dropped codes and with merged ones under their common code."""
    code = F.col("company_code")
    return companies.filter(~code.isin(*dropped)).replace(recoded, subset=["company_code"])


def _overridden(column: str, part: str, overrides: Sequence[Override]) -> Column:
    value = F.col(column)
    for rule in overrides:
        value = F.when(matches(F.col("name_start"), rule.pattern), F.lit(getattr(rule, part))).otherwise(value)
    return value.alias(column)


def conform_companies(companies: DataFrame, panel: DataFrame, length: int = PREFIX_LENGTH,
                      dropped: Sequence[str] = DROPPED_CODES, recoded: dict[str, str] = RECODED,
                      overrides: Sequence[Override] = OVERRIDES) -> DataFrame:
    """Every prefix found in fund names or company names, with the company it stands for.

    Names on both sides are brought to ASCII. Prefixes that match no company stay without one.
    """
    listed = merge_company_codes(companies, dropped, recoded).withColumn(
        "company_name", latin_ascii(F.col("company_name")))
    listed = listed.withColumn("name_start", prefix(F.col("company_name"), length))
    names = panel.select("name").distinct().select(latin_ascii(F.col("name")).alias("name"))
    joined = name_starts(names, length).join(listed, "name_start", "full_outer")
    return joined.select(
        "name_start",
        _overridden("company_code", "code", overrides),
        _overridden("company_name", "name", overrides),
        _overridden("company_type", "kind", overrides),
    )


def attach_company(panel: DataFrame, conformed: DataFrame, length: int = PREFIX_LENGTH) -> DataFrame:
    """Panel with ASCII names and the company of each name's prefix.

    The row count cannot change: there is one row per prefix to join, and a name that matches two
    companies is an error whichever columns are read.
    """
    # A few companies hold most names. Taking the prefix anew puts a shuffle between the check and the
    # join; only then can the join be split at run time where the companies are too many to broadcast.
    company = F.min(F.struct("company_name", "company_code"))
    dim = conformed.filter(F.col("name_start").isNotNull()).groupBy("name_start").agg(
        company.alias("_company"), F.count(F.lit(1)).alias("_companies"),
    ).withColumn("name_start", prefix(F.col("name_start"), length))
    renamed = panel.withColumn("name", latin_ascii(F.col("name")))
    joined = renamed.withColumn("name_start", prefix(F.col("name"), length)).join(dim, "name_start", "left")
    return single(joined, "_companies", "company", "name_start").select(*renamed.columns, "_company.company_name", "_company.company_code")


def without_company(panel: DataFrame) -> DataFrame:
    """Rows whose name matched no company; expected to be empty."""
    return panel.filter(F.col("company_name").isNull() | F.col("company_code").isNull())
