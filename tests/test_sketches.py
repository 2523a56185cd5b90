"""Profiles and histograms from mergeable summaries: exact counts, bounded errors, no raw rows after the first pass."""

from __future__ import annotations

import random

import pytest

from conftest import as_dicts, plan_of
from panelmill.operators import sketches
from panelmill.operators.quality import dq_profile

NAN = float("nan")


def test_profile_of_a_range(frame):
    rows = [("a", "A", 1.0, 1.0, "2020-01-01", "x"), ("b", None, 2.0, 0.0, "2020-01-02", None), ("a", "A", None, 1.0, "2020-01-02", "x"),
            (None, "C", NAN, 5.0, "2020-01-03", "x"), ("z", "Z", 9.0, 1.0, None, "x")]
    df = frame(rows, "code string, name string, price double, shares double, date date, category string")
    days = sketches.day_profiles(df)
    got = as_dicts(sketches.merged_profile(days, "2020-01-01", "2020-01-03"))[0]
    assert got == {"rows": 4, "null_code": 1, "null_name": 1, "null_price": 2, "null_shares": 0, "null_category": 1,
                   "zero_or_missing": 3, "values": 2, "codes": 2, "quantiles": [1.0, 1.0, 2.0]}
    only = as_dicts(sketches.merged_profile(days, "2020-01-03", "2020-01-03"))[0]
    assert (only["rows"], only["codes"], only["values"], only["quantiles"]) == (1, 0, 0, None)
    none = as_dicts(sketches.merged_profile(days, "2021-01-01", "2021-01-03"))[0]
    assert (none["rows"], none["codes"], none["quantiles"]) == (0, 0, None)


def test_profile_equals_the_exact_counts_for_any_split(spark, frame):
    draw = random.Random(4)
    rows = [(f"c{draw.randrange(3000)}", None if draw.random() < .1 else "n", draw.lognormvariate(0, 3), float(draw.randrange(3)),
             f"2020-01-{draw.randrange(1, 29):02d}", "x") for _ in range(20_000)]
    df = frame(rows, "code string, name string, price double, shares double, date date, category string")
    exact = as_dicts(dq_profile(df))[0]
    first = sketches.day_profiles(df.filter("dayofmonth(date) <= 9"))
    rest = sketches.day_profiles(df.filter("dayofmonth(date) > 9"))
    got = as_dicts(sketches.merged_profile(first.unionByName(rest), "2020-01-01", "2020-01-31", quantiles=(.01, .5, .99)))[0]
    assert all(got[c] == exact[c] for c in got if c in exact and c != "codes")
    assert abs(got["codes"] - exact["codes"]) <= exact["codes"] * sketches.distinct_error()
    prices = sorted(r[2] for r in rows)
    for q, v in zip((.01, .5, .99), got["quantiles"]):
        rank = sum(p <= v for p in prices) / len(prices)
        assert abs(rank - q) <= 2 * sketches.rank_error()


def test_stored_profiles_are_read_without_raw_rows(spark, frame, tmp_path):
    df = frame([("a", "A", 1.0, 1.0, "2020-01-01", "x")], "code string, name string, price double, shares double, date date, category string")
    sketches.day_profiles(df).write.parquet(str(tmp_path / "days"))
    plan = plan_of(sketches.merged_profile(spark.read.parquet(str(tmp_path / "days")), "2020-01-01", "2020-02-01"))
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(date" in plan


@pytest.mark.parametrize("spread", [0.1, 4.0])
def test_quantile_bins_of_a_skewed_column(spark, spread):
    draw = random.Random(7)
    rows = [(i % 30, "hot" if i % 3 else "cold", draw.lognormvariate(0, spread)) for i in range(60_000)]
    df = spark.createDataFrame(rows, "day int, facet string, v double")
    days = sketches.rank_summaries(df, "v", ["day", "facet"])
    edges = sketches.quantile_edges(sketches.merged_summaries(days, ["facet"]), ["facet"], 20)
    bins = as_dicts(sketches.quantile_histogram(df, "v", spark.createDataFrame(edges.collect(), edges.schema), "facet"))
    for facet, n in (("hot", 40_000), ("cold", 20_000)):
        own = [b for b in bins if b["facet"] == facet]
        assert [b["bin"] for b in own] == list(range(20)) and sum(b["count"] for b in own) == n
        assert all(abs(b["count"] / n - 1 / 20) <= 4 * sketches.rank_error() for b in own)
        assert all(x["high"] == y["low"] for x, y in zip(own, own[1:]))


def test_odd_values(frame):
    df = frame([(None, 5.0), (None, 5.0), ("a", None), ("a", NAN), ("b", 1.0), ("b", 1.0), ("b", 1.0), ("b", 2.0)], "facet string, v double")
    edges = sketches.quantile_edges(sketches.rank_summaries(df, "v", ["facet"]), ["facet"], 2)
    assert {r["facet"]: r["edges"] for r in as_dicts(edges)} == {None: [5.0, 5.0, 5.0], "b": [1.0, 1.0, 2.0]}
    got = as_dicts(sketches.quantile_histogram(df, "v", edges, "facet"))
    assert [tuple(r.values()) for r in got] == [("b", 0, 1.0, 1.0, 3), ("b", 1, 1.0, 2.0, 1), (None, 0, 5.0, 5.0, 2)]
    ranks = as_dicts(sketches.edge_ranks(df, "v", edges, "facet", 3))
    assert {"facet": "b", "values": 4, "edge": 1, "below": 0, "up_to": 3} in ranks
    empty = df.filter("v > 99")
    assert sketches.quantile_edges(sketches.rank_summaries(empty, "v", ["facet"]), ["facet"], 2).collect() == []
