"""Near-duplicate vectors through an inverted multi-index.

The two halves of the unit vectors have independent codebooks, whose product is a grid of cells. Every vector
lives in its nearest cell and visits the nearest cells in the order of the summed half distances (multi-sequence
order) until the target recall; there its cosine with every resident is computed in double precision.
Each pair is counted once for either side and no pairs leave a task: only counts and spanning edges do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.components import components
from panelmill.llm.groups import map_groups
from panelmill.llm.scratch import stored


#: Sums of half distances that are ranked at once.
RANKED = 1 << 22
#: In a list of visits, a cell that cannot hold a link.
NO_VISIT = -(1 << 63)


@dataclass(frozen=True)
class MultiIndex:
    """The codebooks are fitted on at most ``2 * sample`` vectors chosen by a hash of their id. ``cell_rows`` is the
    intended mean number of residents; a task compares at most about ``block`` residents with ``block`` visitors."""

    threshold: float = 0.95
    target_recall: float = 0.99
    sample: int = 8192
    cell_rows: int = 64
    block: int = 4096
    rounds: int = 12
    seed: int = 11


@dataclass(frozen=True)
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def valid(vector: Column) -> Column:
    """Not null, all components finite numbers, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _apart(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)


def codebook(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Codewords by Lloyd's method; a word that loses all its rows stays where it was."""
    book = x[rng.choice(len(x), size, replace=False)]
    for _ in range(rounds):
        near = _apart(x, book).argmin(axis=1)
        count = np.bincount(near, minlength=size)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def nearest_cells(x: np.ndarray, grid: Grid, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each unit vector, nearest first.

    Words of either half are ranked by distance. A cell of ranks (i, j) comes after the (i+1)(j+1) - 1 cells
    of smaller ranks, so only those with (i+1)(j+1) <= n can be among the first n.
    """
    cut, k = grid.first.shape[1], len(grid.second)
    one, two = _apart(x[:, :cut], grid.first), _apart(x[:, cut:], grid.second)
    n = min(n, len(grid.first) * k)
    i, j = np.divmod(np.arange(min(n, len(grid.first)) * min(n, k)), min(n, k))
    inside = (i + 1) * (j + 1) <= n
    i, j = i[inside], j[inside]
    a, b = np.argsort(one, axis=1, kind="stable")[:, :n], np.argsort(two, axis=1, kind="stable")[:, :n]
    one, two = np.take_along_axis(one, a, 1), np.take_along_axis(two, b, 1)
    out, step = np.empty((len(x), n), a.dtype), max(1, RANKED // len(i))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        order = np.argsort(one[part][:, i] + two[part][:, j], axis=1, kind="stable")[:, :n]
        out[part] = np.take_along_axis(a[part], i[order], 1) * k + np.take_along_axis(b[part], j[order], 1)
    return out


def in_reach(x: np.ndarray, cells: np.ndarray, grid: Grid, threshold: float) -> np.ndarray:
    """Whether each cell can hold a unit vector whose cosine with the row is ``threshold`` or more.

    Such a vector is within sqrt(2 - 2 * threshold). In a half, the vectors whose nearest word is c are on c's side of the
    plane midway between c and the row's own nearest word, so the distance to that plane is a lower bound; the squares of
    both halves' bounds add up.
    """
    cut, bound = grid.first.shape[1], 0.0
    for half, book, word in ((x[:, :cut], grid.first, cells // len(grid.second)), (x[:, cut:], grid.second, cells % len(grid.second))):
        apart = _apart(half, book)
        home = apart.argmin(axis=1)
        further = np.take_along_axis(apart, word, 1) - apart[np.arange(len(x)), home][:, None]
        between = np.sqrt(np.maximum(_apart(book, book), 0))[home[:, None], word]
        away = np.divide(further, 2 * between, out=np.zeros_like(further), where=between > 1e-6)
        bound = bound + np.square(np.maximum(away, 0))
    return bound <= 2 - 2 * threshold + 1e-9


def closer_cells(x: np.ndarray, cells: np.ndarray, grid: Grid) -> np.ndarray:
    """How many other cells each unit vector visits before its given cell (or as early: sums within rounding are counted).

    Counted from the sorted distances of either half, one vector at a time: memory grows with the codebooks, not the grid.
    """
    cut, k = grid.first.shape[1], len(grid.second)
    one, two = _apart(x[:, :cut], grid.first), np.sort(_apart(x[:, cut:], grid.second), axis=1)
    limit = (one[np.arange(len(x)), cells // k] + _apart(x[:, cut:], grid.second)[np.arange(len(x)), cells % k]) + 1e-12
    return np.array([np.searchsorted(b, most - a, "right").sum() - 1 for a, b, most in zip(one, two, limit)], np.int64)


def fit(vectors: np.ndarray, rows: int, cfg: MultiIndex) -> Grid:
    """Grid for ``rows`` vectors from a sample. The number of visits is what finds ``target_recall`` of the hardest
    links: vectors drawn from the sample and turned by exactly the threshold angle in random directions."""
    x, rng = unit(vectors), np.random.default_rng(cfg.seed)
    size = int(np.clip(round((rows / cfg.cell_rows) ** 0.5), 1, max(1, len(x) // 16)))
    cut = x.shape[1] // 2
    books = [codebook(half, size, cfg.rounds, rng) for half in (x[:, :cut], x[:, cut:])]
    every = Grid(*books, size * size)
    if size == 1:
        return every
    x = x[rng.choice(len(x), min(len(x), 1024), replace=False)]
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = cfg.threshold * x + (1 - cfg.threshold**2) ** 0.5 * unit(aside)
    there = np.stack([closer_cells(a, nearest_cells(b, every, 1)[:, 0], every) for a, b in ((x, y), (y, x))])
    return Grid(*books, int(np.quantile(there.min(axis=0), cfg.target_recall, method="higher")) + 1)


def classes(vectors: DataFrame) -> DataFrame:
    """node (least vec_id), n (rows) and embedding of each distinct valid vector with a name."""
    return (
        vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
        .groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))


def grids(distinct: DataFrame, cfg: MultiIndex) -> dict[int, tuple[Grid, int]]:
    """Grid and first cell number for the most frequent length and every length of more than two blocks of vectors."""
    sizes = distinct.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dim").collect()
    out, cells = {}, 0
    for i, size in enumerate(sizes):
        if i and size["rows"] <= 2 * cfg.block:
            break
        rows = distinct.filter(F.size("embedding") == size["dim"])
        part = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
        chosen = rows.filter(part < cfg.sample / size["rows"]).select("node", "embedding").limit(2 * cfg.sample).collect()
        chosen = chosen or rows.select("node", "embedding").limit(cfg.sample).collect()
        grid = fit(np.array([r["embedding"] for r in sorted(chosen)], np.float64), size["rows"], cfg)
        out[size["dim"]] = grid, cells
        cells += len(grid.first) * len(grid.second)
    return out


def stored_kind(vectors: DataFrame) -> type:
    """The floating type that holds the components without loss."""
    return np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64


def index(distinct: DataFrame, cfg: MultiIndex) -> DataFrame:
    """node, n, e (bytes of the components as they are stored, floats or doubles), cell and visits of all vectors.

    Of the nearest cells, those out of the threshold's reach are not visited.
    A length without a grid is a single cell (of a negative number), in which all vectors are compared, in blocks.
    """
    found, kind = grids(distinct, cfg), stored_kind(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                for lo in range(0, len(own), 1024):
                    part = batch.take(pa.array(own[lo:lo + 1024]))
                    given = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    if dim in found:
                        grid, first = found[dim]
                        x = unit(given.astype(np.float64))
                        near = nearest_cells(x, grid, grid.visits).astype(np.int64)
                        cells = np.where(in_reach(x, near, grid, cfg.threshold), near + first, NO_VISIT)
                        cells[:, 0] = near[:, 0] + first
                    else:
                        cells = np.full((len(given), 1), -dim, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("n"), pa.array([r.tobytes() for r in given], pa.binary()),
                         pa.array(cells[:, 0].copy()), pa.array(list(cells), pa.list_(pa.int64()))],
                        ["node", "n", "e", "cell", "visits"])
    indexed = distinct.select("node", "n", "embedding").mapInArrow(run, "node long, n long, e binary, cell long, visits array<long>")
    return stored(indexed, "vector-index")


def in_cells(indexed: DataFrame, cfg: MultiIndex) -> DataFrame:
    """Residents and visitors of each cell with two residents or more, in blocks of bounded size either way."""
    home = F.col("cell").alias("home")
    visited = F.explode(F.filter("visits", lambda c: c != NO_VISIT)).alias("cell")
    visitors = indexed.select(
        visited, F.lit(False).alias("resident"), "node", "n", "e", home,
        F.array().cast("array<long>").alias("visits"))
    residents = indexed.select("cell", F.lit(True).alias("resident"), "node", "n", "e", home, "visits")
    count = indexed.groupBy("cell").agg(F.count("*").alias("_r"))
    coming = indexed.select(visited).groupBy("cell").agg(F.count("*").alias("_v"))
    size = count.join(coming, "cell").filter("_v > 1").select(
        "cell", F.ceil(F.col("_r") / cfg.block).cast("int").alias("_r"), F.ceil(F.col("_v") / cfg.block).cast("int").alias("_v"))
    rows = residents.unionAll(visitors).join(size, "cell")

    def dealt(own: Column, n: Column) -> Column:
        """The row's own block if it is dealt by this count, else all of them."""
        return F.when(own, F.array(F.pmod(F.xxhash64("node"), n).cast("int"))).otherwise(F.sequence(F.lit(0), n - 1))

    return (
        rows.withColumn("block_r", F.explode(dealt(F.col("resident"), F.col("_r"))))
        .withColumn("block_v", F.explode(dealt(~F.col("resident"), F.col("_v")))).drop("_r", "_v"))


def cell_links(indexed: DataFrame, cfg: MultiIndex, kind: type = np.float64) -> DataFrame:
    """node, links, root: links found for a vector in a cell, and the least vector it is connected with there."""
    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n, home = (table.column(c).to_numpy() for c in ("node", "n", "home"))
        resident = table.column("resident").to_numpy()
        visits, out = table.column("visits").combine_chunks(), []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
            r, v = np.flatnonzero(resident[lo:hi]), np.flatnonzero(~resident[lo:hi])
            if len(r) and len(v):
                e = np.frombuffer(b"".join(table.column("e").slice(lo, hi - lo).to_pylist()), kind).reshape(hi - lo, -1)
                e = unit(e.astype(np.float64))
                seen = np.stack(visits.take(pa.array(lo + r)).to_numpy(zero_copy_only=False))
                out += _compare(node[lo:hi], n[lo:hi], home[lo:hi], e, r, v, seen, cfg.threshold)
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [(), (), ()])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "links", "root"])
    rows = in_cells(indexed, cfg).select("cell", "block_r", "block_v", "resident", "node", "n", "home", "e", "visits")
    return map_groups(rows, ["cell", "block_r", "block_v"], run, "node long, links long, root long")


def _compare(node, n, home, e, r, v, seen, threshold) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every visitor with every resident. A resident that does not visit the visitor's home gets the link from here."""
    near = np.empty((len(v), len(r)), bool)
    for i in range(0, len(v), 512):
        near[i:i + 512] = e[v[i:i + 512]] @ e[r].T >= threshold
    near &= node[v][:, None] != node[r][None, :]
    rows, columns = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return []
    near, v, r, seen = near[rows][:, columns], v[rows], r[columns], seen[columns]
    mine, theirs = near @ n[r], np.zeros(len(r), np.int64)
    for h in np.unique(home[v]).tolist():
        blind = ~(seen == h).any(axis=1)
        if blind.any():
            own = home[v] == h
            theirs[blind] += n[v][own] @ near[own][:, blind]
    root_v, root_r, far = node[v].copy(), node[r].copy(), np.iinfo(np.int64).max
    while True:
        before = root_v.sum(), root_r.sum()
        root_v = np.minimum(root_v, np.where(near, root_r, far).min(axis=1))
        root_r = np.minimum(root_r, np.where(near, root_v[:, None], far).min(axis=0))
        if before == (root_v.sum(), root_r.sum()):
            return [(node[v], mine, root_v), (node[r], theirs, root_r)]


def near_duplicates(vectors: DataFrame, cfg: MultiIndex = MultiIndex()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one node with a weight. Vectors that are null or zero or hold null or non-finite components,
    and rows without vec_id, link with nothing (component_id is the vec_id). Only vectors of equal length link; each
    frequent length has its own grid, and vectors of rarer ones are all compared. Other columns are ignored.
    """
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = stored(classes(table), "vector-classes")
    links = distinct.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    links = links.unionAll(stored(cell_links(index(distinct, cfg), cfg, stored_kind(distinct)), "cell-links"))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.join(total, "node").join(joined, "node", "left").select(
        F.col("embedding").alias("_e"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = F.col("vec_id").isNotNull() & valid(F.col("embedding")) & (F.col("embedding") == F.col("_e"))
    component = F.coalesce("component", "vec_id")
    return table.join(named, own, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
