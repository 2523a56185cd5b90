"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import parity
from panelmill.plans.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_matches_sql(spark, con, name):
    entry = CATALOG[name]
    assert parity.compare(entry.run(spark, SF_DIR), con, entry.sql) is None


def test_contract(spark):
    assert set(CATALOG) <= set(contract.oracle_sql()) <= set(contract.queries())
    result = contract.entry(spark)
    assert result.count() > 0
    assert {"annual_change", "stdev", "avg_daily_change"} <= set(result.columns)
