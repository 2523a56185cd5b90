"""Product flags read from names, and the prefix profile used to choose a matching key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.text import matches, prefix
from panelmill.schema import FLAGS

# Patterns per flag and column; case and the spaces count.
FLAG_PATTERNS = {
    "OKS": {"name": " OKS "},
    "participation": {"name": " KATILIM ", "category": " participation  "},
    "contribution": {"name": " KATKI ", "category": " contribution "},
}


def product_flags(df: DataFrame, patterns: Mapping[str, Mapping[str, str]] = FLAG_PATTERNS) -> DataFrame:
    """Adds one boolean per flag: true where any of its patterns is found."""
    flags = {}
    for flag, tests in patterns.items():
        found = F.lit(False)
        for column, pattern in tests.items():
            found = found | matches(F.col(column), pattern)
        flags[flag] = found
    return df.withColumns(flags)


def flag_counts(df: DataFrame, patterns: Mapping[str, Mapping[str, str]] = FLAG_PATTERNS) -> DataFrame:
    """Distinct codes per combination of flags; patterns run on distinct names only."""
    named = product_flags(df.select("code", "name", "category").distinct(), patterns)
    return (
        named.select(*FLAGS, "code").distinct()
        .groupBy(*FLAGS).agg(F.count(F.lit(1)).alias("codes")).orderBy(*FLAGS)
    )


def prefix_cardinality(df: DataFrame, column: str = "name", longest: int = 25) -> DataFrame:
    """Distinct prefixes of each length 1..longest, in one job."""
    names = df.select(column).distinct()
    lengths = names.select(F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("length"), column)
    return (
        lengths.select("length", F.substring(F.col(column), F.lit(1), F.col("length")).alias("start")).distinct()
        .groupBy("length").agg(F.count(F.lit(1)).alias("prefixes")).orderBy("length")
    )


def name_starts(df: DataFrame, length: int, column: str = "name") -> DataFrame:
    """Distinct prefixes of one length."""
    return df.select(prefix(F.col(column), length).alias("name_start")).distinct()
