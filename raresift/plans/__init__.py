"""End-to-end flows and the registered query catalog."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "raresift.plans.evaluation_queries",
    "raresift.plans.data_queries",
    "raresift.plans.sampling_queries",
    "raresift.plans.anomaly_queries",
    "raresift.plans.model_queries",
    "raresift.plans.streaming_queries",
    "raresift.plans.io_queries",
)


def load_all():
    """Import every query module; return (queries, oracle_sql)."""
    for m in QUERY_MODULES:
        importlib.import_module(m)
    from raresift.plans.catalog import ORACLE, QUERIES

    return QUERIES, ORACLE
