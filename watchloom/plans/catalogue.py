"""All registered queries."""

from __future__ import annotations

from watchloom.plans import (  # noqa: F401 - importing registers the queries
    class_queries,
    coverage_queries, entry_queries, expand_queries, feed_queries, flows, function_queries, io_queries,
    lookup_queries, normalize_queries, profile_queries, sequence_queries)
from watchloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
