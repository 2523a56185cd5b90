"""Price and allocation rows of every source joined into one panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.guards import single

KEYS = ("date", "code", "fund_type")


def _keyed(rows: DataFrame, side: str, what: str) -> tuple[DataFrame, list[str]]:
    """Rows with their join key; more than one row of a key is an error.

    A key column joins as its value and whether it is missing, so that missing equals missing. The count
    is taken over the columns that are joined on, so it needs no shuffle or sort of its own. A hash of the key
    comes first among them: almost every comparison of the sorts and the join ends at that one number. The key
    travels once, as the columns that are joined on.
    """
    filled = {"date": F.lit("0001-01-01").cast("date"), "code": F.lit(""), "fund_type": F.lit("")}
    values = [F.coalesce(F.col(k), filled[k]).alias(f"_{k}") for k in KEYS]
    missing = sum(F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(KEYS))
    keyed = rows.select(F.xxhash64(*KEYS).alias("_hash"), *values, missing.alias("_missing"), *[c for c in rows.columns if c not in KEYS])
    on = ["_hash", *(f"_{k}" for k in KEYS), "_missing"]
    counted = keyed.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*on))).withColumns(
        {k: F.when(F.col("_missing").bitwiseAND(1 << i) == 0, F.col(f"_{k}")) for i, k in enumerate(KEYS)})
    return single(counted, "_rows", what, *KEYS).alias(side), on


def consolidate_daily(prices: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """Full outer join of both row sets on date, code and type, then the category of each code.

    A missing key equals a missing key. A key that occurs twice on a side is an error, and so is a code
    with two rows in ``categories``; whether that is broadcast is left to the size Spark measures.
    """
    measures = [c for c in prices.columns if c not in (*KEYS, "name")]
    shares_of = [c for c in allocations.columns if c.startswith("p_")]
    left, on = _keyed(prices, "l", "price row")
    right, _ = _keyed(allocations.select(*KEYS, *shares_of), "r", "allocation row")
    joined = left.join(right, on, "full_outer").selectExpr(
        *[f"coalesce(l.{k}, r.{k}) AS {k}" for k in KEYS], "l.name",
        *[f"l.{c}" for c in measures], *[f"r.`{c}`" for c in shares_of],
    )
    known = single(
        categories.groupBy(F.col("code").alias("_code")).agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("_rows")),
        "_rows", "category", "_code")
    return joined.join(known, joined["code"].eqNullSafe(known["_code"]), "left").select(
        "date", "code", "fund_type", "category", "name", *measures, *shares_of)
