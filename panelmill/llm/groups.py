"""Work on the groups of a key without ever holding an unbounded group in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GroupsFn = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def in_blocks(df: DataFrame, group: str, member: str, weight: Column, limit: int) -> DataFrame:
    """Adds ``block_a`` and ``block_b`` so that (group, block_a, block_b) holds about ``2 * limit`` of weight.

    A group within the limit keeps its rows once. A heavier one is dealt by a hash of ``member`` into
    blocks, and a row goes along once with every other block, so any two members still meet
    somewhere. Groups of one member are left out.
    """
    size = (
        df.groupBy(group).agg(F.sum(weight).alias("_w"), F.min(member).alias("_lo"), F.max(member).alias("_hi"))
        .filter("_lo < _hi")
        .select(group, F.ceil(F.col("_w") / F.lit(float(limit))).cast("int").alias("_n")))
    own = F.pmod(F.xxhash64(member), F.col("_n")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: (x != F.col("_own")) | (F.col("_n") == 1))
    return (
        df.join(size, group).withColumn("_own", own).withColumn("_other", F.explode(others))
        .withColumns({"block_a": F.least("_own", "_other"), "block_b": F.greatest("_own", "_other")})
        .drop("_n", "_own", "_other"))


def map_groups(df: DataFrame, keys: Sequence[str], fn: GroupsFn, schema: str) -> DataFrame:
    """Calls ``fn(rows, starts)`` with whole groups of ``keys``: many small ones at a time.

    Rows are hashed and sorted by the keys; a task reads them as a stream and holds one Arrow batch
    and the group that runs over its end.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _starts(batch, names)[-1]
            if cut == 0 and held and _same(held[-1], batch, names):
                held.append(batch)
                continue
            if held or cut:
                whole = [*held, batch.slice(0, cut)] if cut else held
                yield from _call(pa.Table.from_batches(whole))
            held = [batch.slice(cut)]
        if held:
            yield from _call(pa.Table.from_batches(held))

    def _call(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        yield from fn(table, _starts(table, names))

    return df.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


def _starts(rows: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Index of the first row of each group."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in names:
        column = rows.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, names: list[str]) -> bool:
    return all(a.column(n)[a.num_rows - 1].as_py() == b.column(n)[0].as_py() for n in names)


def spanning_forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect 0..n-1 exactly as all links would, without comparing members already connected.

    ``near(i, others)`` says which others link with i. Breadth first: a member is compared with those
    not reached yet, so a group that holds together costs few comparisons.
    """
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = left[~hit]
    return edges
