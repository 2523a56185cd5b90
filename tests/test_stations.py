"""Station snapshot on a hand-written document."""

from __future__ import annotations

import json

import pytest

from conftest import as_dicts
from panelmill.operators import stations as st

FIELDS = st.STATION_FIELDS
RECORDS = [
    ("g1", "1", "Fresh", "1", "5", "15", "41.0", "29.0", "2020-11-18T10:00:00"),
    ("g2", "2", "Stale", "1", "10", "0", "41.1", "29.1", "2020-11-16T10:00:00"),
    ("g3", "3", "Empty", "0", "0", "0", "41.2", "29.2", "2020-11-18T09:00:00.250"),
    ("g4", "4", "Nowhere", "1", "x", "3", "0", "29.0", "2020-11-17T10:00:00"),
    ("g5", "5", "Large", "1", "1", "29", "41.0", "29.0", "2020-11-18T08:00:00"),
]


@pytest.fixture
def snapshot(frame):
    document = json.dumps({"dataList": [dict(zip(FIELDS, r)) for r in RECORDS]})
    return st.station_snapshot(st.typed_stations(st.station_rows(frame([(document,)], "value string"))))


def test_derived_columns(snapshot):
    rows = {r["STATION_NAME"]: r for r in as_dicts(snapshot)}
    derived = {n: (r["TOTAL"], r["RATE"], r["ACTIVE_SUSPICION"], r["TEST_DATA"], r["TOTAL_BIN"]) for n, r in rows.items()}
    assert derived == {
        "Fresh": (20.0, 75, 1, 0, "medium"), "Stale": (10.0, 0, 0, 0, "small"), "Empty": (0.0, None, 1, 0, "small"),
        "Nowhere": (None, None, 1, 1, None), "Large": (30.0, 96, 1, 0, "large")}


def test_reports(snapshot):
    stale = st.stale_stations(snapshot)
    assert stale.columns == list(st.REPORT.values()) and [r["Station Name"] for r in stale.collect()] == ["Stale"]
    assert [r["Station Name"] for r in st.busiest_stations(snapshot).collect()] == ["Large", "Fresh", "Empty"]


def test_utilisation_and_points(snapshot):
    shown = st.StationFilter(empty=(0, 5), rate=(50, 100))
    assert sorted((r.RATE, r.EMPTY, r.TOTAL_BIN) for r in st.capacity_utilisation(snapshot, shown).collect()) == [
        (75, 5.0, "medium"), (96, 1.0, "large")]
    points = {r.label: r for r in st.station_points(snapshot, st.StationFilter(empty=(5, 5))).collect()}
    assert points["Fresh"].popup == "Station No: 1 Active: 1 Empty: 5 Full: 15 Last Connection: 2020-11-18 10:00:00"
    assert (points["Fresh"].lng, points["Fresh"].lat) == (29.0, 41.0)
    hidden = st.station_points(snapshot, st.StationFilter(positioned=False)).collect()
    assert hidden[0].popup == "Station No: 4 Active: 1 Empty: NA Full: 3 Last Connection: 2020-11-17 10:00:00"
