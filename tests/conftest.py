from __future__ import annotations

import datetime as dt

import pytest

from panelmill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__sql__maxMetadataStringLength="2000", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Frame from tuples and a DDL schema; text in date columns is read as a date."""

    def build(rows, ddl):
        dates = [i for i, c in enumerate(ddl.split(",")) if c.strip().endswith(" date")]
        fixed = [tuple(dt.date.fromisoformat(v) if i in dates and isinstance(v, str) else v for i, v in enumerate(r)) for r in rows]
        return spark.createDataFrame(fixed, ddl)

    return build


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def plan_of(df) -> str:
    """Physical plan text."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    """Physical plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = plan_of(df)
    return text.split("== Initial Plan ==")[0]
