"""The registered queries against SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
import parity
from panelmill.llm.queries import QUERIES, SQL
from panelmill.llm.scratch import stored

SF_DIR = "/root/testdata/sf0.001"
NATIVE = ("op7_line_dedup", "op8_decontaminate", "op12_merkle")


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert parity.compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kinds, ids = docs.dtypes, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.dtypes == kinds and len(set(left)) == len(left) and set(left) <= ids, name
        ids = set(left)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == ids and all(len(r.ids) == r.n_tokens for r in rows.values())
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()} == {(i, r.ids_sha256) for i, r in rows.items()}
