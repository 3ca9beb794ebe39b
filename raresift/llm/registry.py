"""Queries of this package: ``(spark, sf_dir) -> DataFrame`` and DuckDB text."""

from __future__ import annotations

import importlib

from raresift.llm.catalog import ORACLE, QUERIES

QUERY_MODULES = (
    "raresift.llm.sentencepiece",
    "raresift.llm.chat",
    "raresift.llm.sharding",
    "raresift.llm.langid",
    "raresift.llm.packing",
    "raresift.llm.fingerprint",
    "raresift.llm.hnsw",
    "raresift.llm.jaccard",
    "raresift.llm.suffix",
    "raresift.llm.pitman_yor",
    "raresift.llm.ballcodes",
    "raresift.llm.quality",
    "raresift.llm.hardneg",
)


def load_all():
    """Import every operator module; return (queries, oracle_sql)."""
    for m in QUERY_MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE
