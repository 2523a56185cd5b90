"""A trie of conversation prefixes: which conversations begin alike, and what sharing the beginnings saves.

Each turn is a code of 20 bytes (128 bits of hash over role and text, and the length of the text), each conversation the
bytes of its codes in a row, whose order is the lexicographic order of the turns. Equal conversations are counted
first, so a group of copies is one row. The distinct sequences are dealt to range shards; a shard numbers its codes in
order and builds a ternary search tree, putting in the middle sequence of every range first. One pass over the
tree by a stack adds up members, leaves and savings from below. Only the beginnings that a shard's first or last
sequence shares with its neighbours lie in several shards; these boundary nodes are added up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.scratch import stored

CODE = 20
NONE = -1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, seq: every conversation with its first h turns taken from conversation c - c % ``group``.

    h is the unsigned crc32 of the decimal conv_id modulo ``most``. Turns are in the order of ``turn``, null first, and
    those of one number in the order of their codes; a null role or text is empty. Rows without conv_id belong to no
    conversation and are left out. Only codes travel, never texts: a conversation takes 28 bytes per turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
                    F.octet_length(text).alias("n_bytes"))
    turns = (
        conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    turns = stored(turns.select("conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns")), "turns")
    base = turns.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    heads = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    out = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": heads.cast("int")}).join(base, "base", "left")
    own = F.filter("turns", lambda t, i: i >= F.col("h"))
    given = F.filter(F.coalesce("head", F.expr("slice(turns, 1, 0)")), lambda t, i: i < F.col("h"))
    return _as_bytes(out.select("conv_id", F.concat(given, own).alias("turns")))


def nodes(sequences: DataFrame, per_shard: int = 1 << 18) -> DataFrame:
    """Every node of the trie over (conv_id, seq), see ``rebuilt``; a shard holds about ``per_shard`` turns.

    Repeated pairs count as often as they come; a node's conv_id is its smallest member. No rows, no nodes.
    """
    sequences = stored(sequences, "sequences")
    same = sequences.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    same = stored(same.withColumn("sid", F.md5("seq")), "distinct")
    total = same.agg(F.sum(F.octet_length("seq"))).first()[0]
    if total is None:
        return sequences.sparkSession.createDataFrame([], NODE).drop("key", "parent_key")
    shards = max(1, -(-total // (CODE * per_shard)))
    with_ends = same.join(_ends(sequences, same), "sid", "left").withColumn("ends", F.coalesce(
        "ends", F.sha2(F.encode(F.col("conv_id").cast("string"), "UTF-8"), 256)))
    placed = stored(
        with_ends.select("seq", "n", "conv_id", "ends").repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id()), "shards")
    parts = _with_neighbours(placed).repartition("shard").sortWithinPartitions("shard", "place", "seq").mapInArrow(_shards, f"shard int, {NODE}")
    parts = stored(parts, "parts")
    keyed = parts.filter("key is not null")
    merged = stored(keyed.groupBy("key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY_SHA, F.col("ends_sha256"))), F.lit(EMPTY_SHA)).alias("ends_sha256")), "merged")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    shared = merged.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    # what a shard's own nodes need of the boundary goes to them by shard, so that the root's children meet no single task
    above = keyed.select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    own = parts.filter("key is null").join(above, ["shard", "parent_key"], "left").withColumn(
        "parent_conv_id", F.coalesce("above", "parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return own.select(columns).unionAll(shared.select(columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, the empty one (the root) included.

    conv_id, depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as
    long and string. An empty table has no nodes; a conversation without turns is a member of the root that ends there.
    """
    return nodes(rebuilt(conversations))


def _as_bytes(df: DataFrame) -> DataFrame:
    """conv_id, seq from arrays of (h1, h2, n_bytes), big-endian."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            turns = batch.column("turns")
            flat, at = turns.flatten(), turns.offsets.to_numpy() - turns.offsets[0].as_py()
            h1, h2, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            codes = np.empty(len(flat), np.dtype([("h1", ">u8"), ("h2", ">u8"), ("n", ">u4")]))
            codes["h1"], codes["h2"], codes["n"] = h1.view(np.uint64), h2.view(np.uint64), n
            ends = pa.array((at * CODE).astype(np.int64))
            seq = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), seq.cast(pa.binary())], ["conv_id", "seq"])
    return df.mapInArrow(run, "conv_id long, seq binary")


def _ends(sequences: DataFrame, same: DataFrame) -> DataFrame:
    """sid, ends: SHA-256 of the sorted conv_ids of every sequence that several conversations have.

    The ids are dealt by ranges of (sid, conv_id) and joined to texts there, so a large group is spread over tasks and
    its digest reads a few texts in order.
    """
    many = same.filter("n > 1").select("sid")
    ids = sequences.select(F.md5("seq").alias("sid"), "conv_id").join(many, "sid")
    texts = ids.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(
        _joined_ids, "sid string, first long, ids string")
    return texts.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_digests, "sid string, ends string")


def _joined_ids(batches: Iterator[pa.RecordBatch], most: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sid, ids = batch.column("sid").dictionary_encode(), batch.column("conv_id").to_numpy()
        code = sid.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        starts = np.unique(np.concatenate([starts, np.arange(0, len(ids), most)]))
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sid").take(pa.array(starts)), pa.array(ids[starts]), pa.array(texts, pa.string())], ["sid", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running digest at a time, whatever the length of its texts."""
    now, digest = None, None
    for batch in batches:
        done = []
        for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids")):
            if sid != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = sid, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
        yield _rows(done, ["sid", "ends"])
    if now is not None:
        yield _rows([(now, digest.hexdigest())], ["sid", "ends"])


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)


def _with_neighbours(placed: DataFrame) -> DataFrame:
    """The rows of every shard (place 1), with the last sequence before them (0) and the first after them (2)."""
    edges = placed.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))  # one row for each shard
    order = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def beside(column: str, place: int) -> DataFrame:
        return edges.filter(F.col(column).isNotNull()).select("shard", F.lit(place).alias("place"), F.col(column).alias("seq"))

    rows = placed.withColumn("place", F.lit(1))
    return rows.unionByName(beside("before", 0), allowMissingColumns=True).unionByName(beside("after", 2), allowMissingColumns=True)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and shard[a] != now:
                yield from _shard(held, now)
                held = []
            now = int(shard[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from _shard(held, now)


def _shard(batches: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    place = table.column("place").to_numpy()
    seqs = table.column("seq").to_pylist()
    before = seqs[0] if place[0] == 0 else None
    after = seqs[-1] if place[-1] == 2 else None
    inside = slice(int(place[0] == 0), len(seqs) - int(place[-1] == 2))
    seqs = seqs[inside]
    n, conv, ends = (table.column(c).to_pylist()[inside] for c in ("n", "conv_id", "ends"))
    tree = Tree(seqs, n, conv, ends, 0 if before is None else common(before, seqs[0]), 0 if after is None else common(seqs[-1], after),
                before is not None, after is not None)
    yield from tree.rows(shard)


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their beginning."""
    most = min(len(a), len(b)) // CODE
    same = np.frombuffer(a, np.uint8, most * CODE).reshape(-1, CODE) == np.frombuffer(b, np.uint8, most * CODE).reshape(-1, CODE)
    differ = np.flatnonzero(~same.all(axis=1))
    return int(differ[0]) if len(differ) else most


class Tree:
    """Ternary search tree over sorted, distinct sequences; entry 0 is the root of the trie.

    ``shared_before`` (``shared_after``) turns of the first (last) sequence also begin the sequence of the shard
    before (after), if there is one: these entries are the shard's boundary.
    """

    def __init__(self, seqs: list[bytes], n: list[int], conv: list[int], ends: list[str], shared_before: int, shared_after: int,
                 has_before: bool, has_after: bool):
        raw = np.frombuffer(b"".join(seqs), np.dtype(f"V{CODE}"))
        self.codes, turns = np.unique(raw, return_inverse=True)
        sizes = np.frombuffer(self.codes.tobytes(), np.uint8).reshape(-1, CODE)[:, 16:].copy().view(">u4").ravel().tolist()
        at = np.concatenate([[0], np.cumsum([len(s) // CODE for s in seqs])]).tolist()
        turns = turns.ravel().tolist()
        self.turn, self.size, self.depth, self.parent = [NONE], [0], [0], [NONE]
        self.low, self.same, self.high = [NONE], [NONE], [NONE]
        self.n, self.conv, self.ends = [0], [min(conv)], [EMPTY_SHA]
        paths = {}
        ranges = [(0, len(seqs))]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                middle = (a + b) // 2
                end = self._put(turns[at[middle]:at[middle + 1]], sizes, n[middle], conv[middle])
                self.ends[end] = ends[middle]
                if middle in (0, len(seqs) - 1):
                    paths[middle] = end
                ranges += [(middle + 1, b), (a, middle)]
        first, last = self._path(paths[0]), self._path(paths[len(seqs) - 1])
        self.old = set(first[:shared_before + 1]) if has_before else set()
        self.boundary = self.old | (set(last[:shared_after + 1]) if has_after else set())
        # the last sequence goes on in the next shard if all of it is shared
        self.goes_on = last[-1] if has_after and shared_after == len(last) - 1 else NONE
        self._add_up()

    def _put(self, turns: list[int], sizes: list[int], n: int, conv: int) -> int:
        above = 0
        self._member(0, n, conv)
        for t in turns:
            here = self.same[above]
            if here == NONE:
                here = self.same[above] = self._new(t, sizes[t], above)
            while self.turn[here] != t:
                side = self.low if t < self.turn[here] else self.high
                if side[here] == NONE:
                    side[here] = self._new(t, sizes[t], above)
                here = side[here]
            self._member(here, n, conv)
            above = here
        return above

    def _member(self, entry: int, n: int, conv: int) -> None:
        self.n[entry] += n
        if conv < self.conv[entry]:
            self.conv[entry] = conv

    def _new(self, turn: int, size: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.size, size), (self.depth, self.depth[parent] + 1), (self.parent, parent),
                              (self.low, NONE), (self.same, NONE), (self.high, NONE), (self.n, 0), (self.conv, 1 << 63), (self.ends, EMPTY_SHA)):
            column.append(value)
        return len(self.turn) - 1

    def _path(self, entry: int) -> list[int]:
        path = []
        while entry != NONE:
            path.append(entry)
            entry = self.parent[entry]
        return path[::-1]

    def _add_up(self) -> None:
        """Children, leaves and savings of all entries, by a stack over the links of the tree; children before parents.

        An entry that an earlier shard has too counts there as a child and with its own text once.
        """
        order, stack = [], [0]
        while stack:
            entry = stack.pop()
            order.append(entry)
            stack += [x for x in (self.low[entry], self.same[entry], self.high[entry]) if x != NONE]
        size = len(self.turn)
        self.children, self.leaves, self.saved = [0] * size, [0] * size, [0] * size
        for entry in sorted(order, key=self.depth.__getitem__, reverse=True):
            is_old = entry in self.old
            if self.same[entry] == NONE and entry != self.goes_on:
                self.leaves[entry] = 1
            self.saved[entry] += (self.n[entry] - (0 if is_old else 1)) * self.size[entry]
            above = self.parent[entry]
            if above != NONE:
                self.children[above] += not is_old
                self.leaves[above] += self.leaves[entry]
                self.saved[above] += self.saved[entry]

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """Boundary entries under the hash of their path, the others under null; 50,000 rows at a time."""
        keys: dict[int, bytes] = {}
        for entry in sorted(self.boundary, key=self.depth.__getitem__):
            above = self.parent[entry]
            keys[entry] = hashlib.sha256(b"" if above == NONE else keys[above] + self.codes[self.turn[entry]].tobytes()).digest()
        size = len(self.turn)
        for a in range(0, size, 50_000):
            part = range(a, min(a + 50_000, size))
            key = [keys.get(i) for i in part]
            parents = [self.parent[i] for i in part]
            columns = [
                pa.array([shard] * len(part), pa.int32()), pa.array(key, pa.binary()),
                pa.array([keys.get(p) for p in parents], pa.binary()), pa.array(self.conv[a:part.stop], pa.int64()),
                pa.array(self.depth[a:part.stop], pa.int64()),
                pa.array([None if p == NONE else self.conv[p] for p in parents], pa.int64()),
                *(pa.array(x[a:part.stop], pa.int64()) for x in (self.n, self.children, self.leaves, self.saved)),
                pa.array(self.ends[a:part.stop], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", *(c.split()[0] for c in NODE.split(", "))])
