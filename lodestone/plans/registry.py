"""All registered queries, gathered from the modules of this package."""

from __future__ import annotations

from . import dedup_queries, ingest_queries, metric_queries, snapshot_queries, text_queries, transform_queries, view_queries
from .catalog import ORACLES, QUERIES, Query

MODULES = [ingest_queries, snapshot_queries, dedup_queries, text_queries, transform_queries, view_queries, metric_queries]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
