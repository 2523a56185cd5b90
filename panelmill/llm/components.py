"""Connected components by alternating star operations on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.scratch import stored


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    ``edges`` has columns a and b. Each round points every node's larger neighbours to its smallest one,
    then its smaller neighbours; the number of edges never grows and a chain halves, so the rounds
    follow the logarithm of the longest path. Every round is written, nothing is collected.
    """
    pair = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        pair = stored(_small_star(_large_star(pair)), "edges")
        state = pair.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pair.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(pair: DataFrame) -> DataFrame:
    both = pair.select("a", "b").unionAll(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct())


def _small_star(pair: DataFrame) -> DataFrame:
    least = pair.groupBy("a").agg(F.min("b").alias("m"))
    return (
        pair.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionAll(least.select("a", F.col("m").alias("b"))).distinct())
