"""Compares a Spark result with the SQL result: columns, types, row count and exact values."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    result = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in result.description}
    rows = result.fetchall()
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if set(ours) != set(theirs):
        return f"columns {sorted(set(ours) ^ set(theirs))}"
    kinds = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    if kinds:
        return f"types {kinds}"
    order = sorted(ours)
    place = {c: i for i, c in enumerate(theirs)}
    left = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    right = Counter(tuple(plain(r[place[c]]) for c in order) for r in rows)
    if left == right:
        return None
    extra, lacking = list((left - right).elements()), list((right - left).elements())
    return (f"rows {sum(left.values())} vs {sum(right.values())}, {len(extra)} only here, {len(lacking)} only in SQL; "
            f"{order} {extra[:2]} {lacking[:2]}")
