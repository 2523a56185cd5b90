"""Freshness and utilisation of stations in a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.dates import parse_timestamp
from panelmill.functions.numeric import equal_width_label
from panelmill.operators.guards import require
from panelmill.schema import STATION_FIELDS

SIZES = ("small", "medium", "large")
# Headings of the station report, by column, in report order.
REPORT = {
    "STATION_NO": "Station No",
    "STATION_NAME": "Station Name",
    "TOTAL_BIN": "Station Segment",
    "ACTIVE": "Is Station Active",
    "TOTAL": "Total Bike Count",
    "EMPTY": "Available Bike Count",
    "FULL": "In-Usage Bike Count",
    "RATE": "Active Bike Percentage",
    "ACTIVE_SUSPICION": "Fresh Data(In Last 24 Hours)",
    "TEST_DATA": "Missing Geolocation Data",
    "LAST_CONNECTION": "Station Last Connection Time",
    "LAT": "Latitude",
    "LON": "Longitude",
}


def station_rows(documents: DataFrame, column: str = "value", root: str = "dataList",
                 fields: Sequence[str] = STATION_FIELDS) -> DataFrame:
    """One row of text fields per station of each JSON document, named in document order.

    A document that cannot be read, or has no list under ``root``, is an error; ``unreadable_documents``
    finds them. An empty list has no stations.
    """
    read = documents.select(F.col(column).alias("_text"), _listed(column, root, fields).alias("_stations"))
    sound = require(read, F.col("_stations").isNotNull(), F.concat(
        F.lit(f"no list {root!r} in the document: "), F.coalesce(F.substring("_text", 1, 200), F.lit("NULL"))))
    return sound.select(F.explode("_stations").alias("station")).select("station.*").toDF(*STATION_FIELDS)


def unreadable_documents(documents: DataFrame, column: str = "value", root: str = "dataList",
                         fields: Sequence[str] = STATION_FIELDS) -> DataFrame:
    """Documents without a readable list of stations."""
    return documents.filter(_listed(column, root, fields).isNull())


def readable_documents(documents: DataFrame, column: str = "value", root: str = "dataList",
                       fields: Sequence[str] = STATION_FIELDS) -> DataFrame:
    return documents.filter(_listed(column, root, fields).isNotNull())


def _listed(column: str, root: str, fields: Sequence[str]) -> Column:
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return F.from_json(F.col(column), T.StructType([T.StructField(root, T.ArrayType(record))]))[root]


def typed_stations(rows: DataFrame) -> DataFrame:
    """Text fields as numbers and timestamps; what cannot be read becomes missing."""
    numbers = {c: F.col(c).try_cast("double") for c in ("STATION_NO", "EMPTY", "FULL", "LAT", "LON")}
    return rows.withColumns(numbers | {"LAST_CONNECTION": parse_timestamp(F.col("LAST_CONNECTION"))})


def flag(test: Column) -> Column:
    """1 or 0; missing where the test is."""
    return F.when(test, 1).when(~test, 0)


def station_snapshot(stations: DataFrame, fresh_within: str = "INTERVAL 1 DAY") -> DataFrame:
    """Adds capacity, use in percent, freshness, missing-position mark and size class.

    A station is fresh within one day of the snapshot's own latest connection. Size classes cut the
    capacity range in three. All three limits come from one one-row subquery.
    """
    capacity = F.col("EMPTY") + F.col("FULL")
    limits = stations.agg(F.struct(
        F.min(capacity).alias("low"), F.max(capacity).alias("high"), F.max("LAST_CONNECTION").alias("latest"))).scalar()
    return stations.withColumns({
        "TOTAL": capacity,
        "RATE": F.floor(F.try_divide(F.col("FULL"), capacity) * 100).cast("int"),
        "ACTIVE_SUSPICION": flag(F.col("LAST_CONNECTION") >= limits["latest"] - F.expr(fresh_within)),
        "TEST_DATA": flag((F.col("LAT") == 0) | (F.col("LON") == 0)),
        "TOTAL_BIN": equal_width_label(capacity, limits["low"], limits["high"], SIZES),
    })


def report(snapshot: DataFrame) -> DataFrame:
    """Report columns under their headings."""
    return snapshot.select(*REPORT).toDF(*REPORT.values())


def stale_stations(snapshot: DataFrame) -> DataFrame:
    return report(snapshot.filter(F.col("ACTIVE_SUSPICION") == 0))


def busiest_stations(snapshot: DataFrame) -> DataFrame:
    """Fresh stations with a position, highest use first."""
    usable = snapshot.filter((F.col("ACTIVE_SUSPICION") == 1) & (F.col("TEST_DATA") == 0))
    return report(usable.orderBy(F.desc_nulls_last("RATE"), "STATION_NO"))


@dataclass(frozen=True)
class StationFilter:
    """Which stations to show; a range of ``None`` does not filter."""

    fresh: bool = True
    positioned: bool = True
    empty: tuple[float, float] | None = None
    rate: tuple[float, float] | None = None

    def apply(self, snapshot: DataFrame) -> DataFrame:
        rows = snapshot.filter(
            (F.col("ACTIVE_SUSPICION") == int(self.fresh)) & (F.col("TEST_DATA") == int(not self.positioned)))
        for column, limits in (("EMPTY", self.empty), ("RATE", self.rate)):
            if limits is not None:
                rows = rows.filter(F.col(column).between(*limits))
        return rows


def capacity_utilisation(snapshot: DataFrame, shown: StationFilter = StationFilter(rate=(0, 100))) -> DataFrame:
    return shown.apply(snapshot).select("RATE", "EMPTY", "TOTAL_BIN")


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint").cast("string"), F.lit("NA"))


def station_points(snapshot: DataFrame, shown: StationFilter = StationFilter()) -> DataFrame:
    """Position, label and popup text of each shown station."""
    seen = F.coalesce(F.date_format("LAST_CONNECTION", "yyyy-MM-dd HH:mm:ss"), F.lit("NA"))
    popup = F.concat_ws(
        " ", F.lit("Station No:"), _plain("STATION_NO"),
        F.lit("Active:"), F.coalesce(F.col("ACTIVE").cast("string"), F.lit("NA")),
        F.lit("Empty:"), _plain("EMPTY"), F.lit("Full:"), _plain("FULL"), F.lit("Last Connection:"), seen)
    return shown.apply(snapshot).select(
        F.col("LON").alias("lng"), F.col("LAT").alias("lat"), F.col("STATION_NAME").alias("label"),
        popup.alias("popup"))
