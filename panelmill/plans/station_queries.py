"""Station snapshot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import stations as st
from panelmill.plans.common import Entry, with_views
from panelmill.plans.views import STATIONS_SQL, stations, table


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return st.station_snapshot(stations(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a JSON document with one station record, read back as typed rows."""
    record = F.struct(
        F.col("event_id").cast("string").alias("ID"), F.col("user_id").cast("string").alias("STATION_NO"),
        F.col("event_type").alias("STATION_NAME"), F.lit("1").alias("ACTIVE"),
        F.col("value").cast("string").alias("EMPTY"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).otherwise("n/a").alias("FULL"),
        F.lit("41.5").alias("LAT"), F.lit("0").alias("LON"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("LAST_CONNECTION"))
    document = F.to_json(F.struct(F.array(record).alias("dataList")))
    return table(spark, d, "events").select("event_id", "event_type", document.alias("value"))


def _typed(documents: DataFrame) -> DataFrame:
    rows = st.typed_stations(st.station_rows(documents))
    return rows.withColumn("LAST_CONNECTION", F.col("LAST_CONNECTION").cast("timestamp_ntz"))


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """The documents with some cut short, some without the list, and some missing."""
    value = (
        F.when(F.col("event_id") % 11 == 0, F.expr("left(value, length(value) - 9)"))
        .when(F.col("event_id") % 11 == 1, F.replace("value", F.lit("dataList"), F.lit("other")))
        .when(F.col("event_id") % 11 != 2, F.col("value")))
    return _documents(spark, d).withColumn("value", value)


_DOCUMENTS = """SELECT CAST(event_id AS VARCHAR) AS ID, CAST(user_id AS DOUBLE) AS STATION_NO, event_type AS STATION_NAME,
  '1' AS ACTIVE, CAST(value AS DOUBLE) AS EMPTY, TRY_CAST(CASE WHEN event_type <> 'error'
    THEN json_extract_string(props, '$.k') ELSE 'n/a' END AS DOUBLE) AS "FULL",
  CAST(41.5 AS DOUBLE) AS LAT, CAST(0 AS DOUBLE) AS LON, date_trunc('second', ts) AS LAST_CONNECTION
FROM events"""

_SNAPSHOT_VIEW = """totals AS (SELECT *, EMPTY + "FULL" AS TOTAL FROM stations),
snapshot AS (
  SELECT *, CAST(floor("FULL" / CAST(NULLIF(TOTAL, 0) AS DOUBLE) * 100) AS INTEGER) AS RATE,
    CASE WHEN LAST_CONNECTION >= latest - INTERVAL 1 DAY THEN 1 ELSE 0 END AS ACTIVE_SUSPICION,
    CASE WHEN LAT = 0 OR LON = 0 THEN 1 ELSE 0 END AS TEST_DATA,
    CASE greatest(1, CAST(ceil((TOTAL - lo) / CAST(NULLIF(hi - lo, 0) AS DOUBLE) * 3) AS INTEGER))
      WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large' END AS TOTAL_BIN
  FROM totals, (SELECT max(LAST_CONNECTION) AS latest, min(TOTAL) AS lo, max(TOTAL) AS hi FROM totals))"""
_VIEWS = (STATIONS_SQL, _SNAPSHOT_VIEW)
_REPORT = ", ".join(f'"{column}" AS "{heading}"' for column, heading in st.REPORT.items())
_SHOWN = st.StationFilter(empty=(5, 50), rate=(10, 60))
_SHOWN_SQL = "ACTIVE_SUSPICION = 1 AND TEST_DATA = 0 AND EMPTY BETWEEN 5 AND 50"

QUERIES = {
    "station_documents": Entry(lambda s, d: _typed(_documents(s, d)), _DOCUMENTS),
    "station_documents_readable": Entry(
        lambda s, d: _typed(st.readable_documents(_faulty(s, d))), _DOCUMENTS + " WHERE event_id % 11 > 2"),
    "station_documents_rejected": Entry(
        lambda s, d: st.unreadable_documents(_faulty(s, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("documents")),
        "SELECT event_type, count(*) AS documents FROM events WHERE event_id % 11 <= 2 GROUP BY event_type"),
    "station_snapshot": Entry(
        _snapshot,
        with_views('SELECT * EXCLUDE (latest, lo, hi) FROM snapshot', *_VIEWS)),
    "stale_stations": Entry(
        lambda s, d: st.stale_stations(_snapshot(s, d)),
        with_views(f"SELECT {_REPORT} FROM snapshot WHERE ACTIVE_SUSPICION = 0", *_VIEWS)),
    "busiest_stations": Entry(
        lambda s, d: st.busiest_stations(_snapshot(s, d)),
        with_views(f"SELECT {_REPORT} FROM snapshot WHERE ACTIVE_SUSPICION = 1 AND TEST_DATA = 0", *_VIEWS)),
    "capacity_utilisation": Entry(
        lambda s, d: st.capacity_utilisation(_snapshot(s, d), _SHOWN),
        with_views(f"SELECT RATE, EMPTY, TOTAL_BIN FROM snapshot WHERE {_SHOWN_SQL} AND RATE BETWEEN 10 AND 60", *_VIEWS)),
    "station_points": Entry(
        lambda s, d: st.station_points(_snapshot(s, d), st.StationFilter(empty=(5, 50))),
        with_views(f"""SELECT LON AS lng, LAT AS lat, STATION_NAME AS label,
          CONCAT('Station No: ', STATION_NO, ' Active: ', ACTIVE, ' Empty: ', EMPTY, ' Full: ', "FULL",
            ' Last Connection: ', strftime(LAST_CONNECTION, '%Y-%m-%d %H:%M:%S')) AS popup
          FROM snapshot WHERE {_SHOWN_SQL}""", *_VIEWS)),
}
