"""The prefix trie against plain Python, for any number of shards, and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from odd_tables import table  # noqa: F401
from panelmill.llm import prefix_trie as P

DDL = "conv_id long, turn long, role string, text string, seq string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def brute_force(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in seqs.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(of) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(of), len(p), -1 if not p else min(members[p[:-1]]), len(of), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, of in members.items())


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        length = rng.choice([1, 2, 3, 3, 5, 12])
        rows += [(c, None if t == 0 else t, rng.choice(["user", None, "assistant"]), rng.choice(["a", "é", "", None, "long text"])
                  if t > 1 or rng.random() < 0.3 else "hello", "x") for t in range(length)]
    return rows


@pytest.mark.parametrize("per_shard", [1, 7, 100, 1 << 18])
def test_like_brute_force_for_any_shards(table, per_shard):
    rows = conversations(per_shard)
    built = P.rebuilt(table(rows, DDL))
    assert result(P.nodes(built, per_shard)) == brute_force(rebuilt(rows))


def test_many_copies_and_a_long_conversation(table):
    """A third of the conversations alike, one conversation with 3,000 turns, and one that continues it."""
    rows = [(5 * c, t, "user", f"copy {t}", "x") for c in range(1, 201) for t in range(3)]
    rows += [(5 * c, 0, "user", f"own {c}", "x") for c in range(201, 400)]
    rows += [(5 * 500, t, "user", f"long {t % 7}", "x") for t in range(3_000)] + [(5 * 501, t, "user", f"long {t % 7}", "x") for t in range(3_200)]
    built = P.rebuilt(table(rows, DDL))
    got = result(P.nodes(built, per_shard=500))
    want = rebuilt(rows)
    assert len(got) == 1 + 3 + 199 + 3_200
    assert got[0] == (5, 0, -1, 401, 201, 201, sum(199 * len(f"copy {t}") for t in range(3)) + sum(len(f"long {t % 7}") for t in range(3_000)),
                      hashlib.sha256(b"").hexdigest())
    short = {c: s for c, s in want.items() if len(s) < 10}
    assert {g[7] for g in got if g[0] == 5} == {b[7] for b in brute_force(short) if b[0] == 5}


def test_rebuilt_conversations(table):
    rows = [(c, t, "u", f"{c}:{t}", "x") for c in (0, 1, 2, 3, 4, 7, 12) for t in range(10)]
    got = {r.conv_id: len(r.seq) // P.CODE for r in P.rebuilt(table(rows, DDL)).collect()}
    want = rebuilt(rows)
    assert got == {c: len(s) for c, s in want.items()} and got[7] < 10


def test_odd_conversations(table):
    rows = [(7, 1, "u", "a", "x"), (7, 1, "u", "a", "x"), (None, 1, "u", "b", "x"), (8, None, None, None, "x"), (-3, 2, "u", "x" * 100_000, "x"),
            (10, 1, "u", "", "x"), (10, None, "u", "z", "x")]
    assert result(P.prefix_trie(table(rows, DDL))) == brute_force({c: s for c, s in rebuilt_spark(rows).items()})
    for nothing in (table(rows, DDL).filter("conv_id = 99"), table(rows, DDL).filter("conv_id is null")):
        out = P.prefix_trie(nothing)
        assert out.count() == 0 and "ends_sha256" in out.columns


def rebuilt_spark(rows):
    """As ``rebuilt``, with the remainder of a negative id as SQL has it."""
    own = rebuilt([r for r in rows if r[0] is not None and r[0] >= 0])
    for c in {r[0] for r in rows if r[0] is not None and r[0] < 0}:
        h = zlib.crc32(str(c).encode()) % 9
        own[c] = tuple((r[2] or "", r[3] or "") for r in rows if r[0] == c)[h:]
    return own


def test_ends_of_a_group_over_many_partitions(spark):
    ids = list(range(0, 50_000, 5))
    pairs = spark.createDataFrame([(c, b"\0" * P.CODE) for c in ids], "conv_id long, seq binary").repartition(7)
    same = pairs.groupBy("seq").count().selectExpr("md5(seq) AS sid", "count AS n")
    row = P._ends(pairs, same).first()
    assert row.ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
