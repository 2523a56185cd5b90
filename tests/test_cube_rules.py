"""The comparison cube against the returns, and rules as a table against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts, plan_of
from panelmill.operators import compare, cube, rules
from panelmill.operators.benchmark import LABEL

RETURNS = ("date date, fund_type string, category string, company_name string, name string, OKS boolean, contribution boolean, "
           "participation boolean, monthly_price_change double")


@pytest.fixture(scope="module")
def returns(spark):
    rng = random.Random(3)
    funds = [(rng.choice(["mutual", "pension"]), rng.choice(["x", "y", None]), rng.choice(["c1", "c2"]), f"f{i}", rng.random() < 0.5,
              rng.random() < 0.5, rng.choice([True, False, None])) for i in range(40)] + [(LABEL, LABEL, LABEL, f"b{i}", False, False, False) for i in range(3)]
    rows = [(dt.date(2019, 1 + m, 1), *f, None if rng.random() < 0.2 else rng.uniform(-0.2, 0.2)) for f in funds for m in range(12)]
    return spark.createDataFrame(rows, RETURNS)


@pytest.fixture(scope="module")
def stored(spark, returns, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "c")
    cube.write_cube(returns, path)
    return path


YEAR = {"start": "2019-02-01", "end": "2019-11-01"}
QUERIES = [
    (compare.Comparison(**YEAR), 0), (compare.Comparison(**YEAR, group_by=("fund_type",), missing="drop"), 4),
    (compare.Comparison(**YEAR, group_by=("fund_type", "OKS"), contribution=(True,)), 4),
    (compare.Comparison(**YEAR, group_by=("category",), fund_types=("mutual",)), 2),
    (compare.Comparison(**YEAR, group_by=("category",), companies=("c1",), missing="drop"), 1),
    (compare.Comparison(**YEAR, group_by=("company_name",), fund_types=("ALL",)), 3),
    (compare.Comparison(**YEAR, group_by=("name",), benchmarks=("b1",)), 0),
    (compare.Comparison(**YEAR, funds=("f1", "f2"), missing="drop"), 0),
    (compare.Comparison(**YEAR, fund_types=("nothing",)), 4),
]


@pytest.mark.parametrize("metric", list(compare.METRICS))
@pytest.mark.parametrize("which", range(len(QUERIES)))
def test_cube_gives_what_the_returns_give(spark, returns, stored, which, metric):
    q, level = QUERIES[which]

    def near(df):
        return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r.values()]) for r in as_dicts(df))
    got = cube.compare_from_cube(spark, stored, q, metric)
    assert near(got) == near(compare.compare(returns, q, metric))
    if which:  # without groups and with all types wanted, fund_type is filtered by
        assert f"cuboid-{level}" in cube.best_cuboid(spark, stored, q).inputFiles()[0]


def test_cuboids_shrink_and_are_read_alone(spark, stored):
    sizes = [r.rows for r in spark.read.parquet(f"{stored}/list").orderBy("path").collect()]
    assert sizes == sorted(sizes, reverse=True) or sizes[0] == max(sizes)
    plan = plan_of(cube.compare_from_cube(spark, stored, compare.Comparison(**YEAR, group_by=("fund_type",))))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date,2019-02-01)" in plan
    with pytest.raises(ValueError, match="first level"):
        cube.write_cube(spark.createDataFrame([], RETURNS), f"{stored}-2", [("fund_type",)])
    with pytest.raises(ValueError, match="unknown metric"):
        cube.compare_from_cube(spark, stored, compare.Comparison(), "eval")


def rule_table(spark, patterns):
    return spark.createDataFrame([(i, p, i % 3 == 1, f"code{i}", f"name{i}", "kind") for i, p in enumerate(patterns)], rules.RULES)


@pytest.mark.parametrize("n", [5, 5_000])
def test_the_first_rule_wins_however_many_there_are(spark, n):
    rng = random.Random(n)
    word = lambda least, most: "".join(rng.choice("ABCDÉ.* ") for _ in range(rng.randint(least, most)))
    patterns = [word(1, 6) for _ in range(n)] + ["", None]
    texts = [word(0, 14) for _ in range(400)] + [None, "", "A"]
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, pattern string")
    got = {r.text: r.rule.position for r in rules.first_matches(df, "text", rule_table(spark, patterns)).collect()}
    fits = lambda i, t: bool(patterns[i]) and (t.strip(" ") == patterns[i] if i % 3 == 1 else patterns[i] in t)
    want = {t: min(of) for t in texts if t and (of := [i for i in range(len(patterns)) if fits(i, t)])}
    assert got == want


def test_the_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("text",)], "text string").filter(F.rand() < 2)
    plans = [plan_of(rules.first_matches(df, "text", rule_table(spark, [f"p{i}" for i in range(n)]).repartition(2))) for n in (5, 5_000)]
    assert plans[0].count("\n") == plans[1].count("\n") and plans[0].count("CASE") == plans[1].count("CASE") == 1
