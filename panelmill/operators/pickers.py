"""Cascading choices from a bitmap index over the entities.

The index has a bitmap of entity numbers for every value of every column. The values that are left under some
filters are those whose bitmap meets the filters': OR over the wanted values of a column, AND over the columns. Its size
follows the entities, not the rows of the panel, and no picker reads the panel again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.compare import ALL, GROUPS, Comparison

INDEX = "column string, value string, bucket long, bitmap binary"


def numbered(rows: DataFrame, columns: Sequence[str] = GROUPS) -> DataFrame:
    """The distinct combinations of the columns, each with a number. Write it before it is indexed: the numbers
    hold for one run only."""
    return rows.select(*columns).distinct().withColumn("number", F.monotonically_increasing_id())


def bitmap_index(entities: DataFrame, columns: Sequence[str] = GROUPS) -> DataFrame:
    """``INDEX`` over rows of ``numbered``. A missing value has a bitmap of its own, under NULL."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return (
        entities.select("number", pairs.alias("pair"))
        .groupBy("pair.column", "pair.value", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))


def matching(index: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """bucket, bitmap of the entities with a wanted value in each of the columns; buckets without any are left out."""
    test = F.lit(False)
    for column, values in wanted.items():
        test = test | ((F.col("column") == column) & _is_one_of(values))
    either = index.filter(test).groupBy("column", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    both = either.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return both.filter((F.col("n") == len(wanted)) & (F.bitmap_count("bitmap") > 0)).select("bucket", "bitmap")


def filters_of(q: Comparison | None, column: str) -> dict[str, Sequence]:
    """The filters that a picker of ``column`` stands under; those that want all values are none."""
    if q is None:
        return {}
    wanted = {"fund_type": q.fund_types, "OKS": q.OKS, "contribution": q.contribution, "participation": q.participation}
    if column == "name":
        wanted |= {"category": q.categories, "company_name": q.companies}
    return {c: values for c, values in wanted.items() if ALL not in values}


def choices(index: DataFrame, column: str, q: Comparison | None = None) -> DataFrame:
    """As ``compare.choices``, for text columns: ``"ALL"``, then a missing value, then ascending."""
    values = index.filter(F.col("column") == column).select("value", "bucket", "bitmap")
    wanted = filters_of(q, column)
    if wanted:
        left = matching(index, wanted).withColumnRenamed("bitmap", "_left")
        met = values.join(left, "bucket").select("value", "bucket", F.explode(F.array("bitmap", "_left")).alias("bitmap"))
        values = met.groupBy("value", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap")).filter(F.bitmap_count("bitmap") > 0)
    found = values.select(F.col("value").alias("choice"), F.lit(1).alias("rank")).distinct()
    everything = index.sparkSession.range(1).select(F.lit(ALL).alias("choice"), F.lit(0).alias("rank"))
    return everything.union(found).orderBy("rank", F.asc_nulls_first("choice")).select("choice")


def _is_one_of(values: Sequence) -> Column:
    """A filter's values as the texts that the index has: Spark writes true and false."""
    return F.col("value").isin(*(str(v).lower() if isinstance(v, bool) else str(v) for v in values))
