"""All registered queries by name."""

from __future__ import annotations

from panelmill.plans import benchmark_queries, file_queries, quality_queries, return_queries, staged_queries, station_queries
from panelmill.plans.common import Entry

CATALOG: dict[str, Entry] = {
    **quality_queries.QUERIES,
    **return_queries.QUERIES,
    **benchmark_queries.QUERIES,
    **station_queries.QUERIES,
    **staged_queries.QUERIES,
    **file_queries.QUERIES,
}
