"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

AREAS = ("drift_queries", "load_queries", "scoring_queries", "explain_queries", "record_queries", "stream_queries")

QUERIES, ORACLE = {}, {}
for area in AREAS:
    module = import_module(f"workload.{area}")
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
