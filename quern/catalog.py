"""Registry of the core's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import checks, concepts, ingest, names, relational, retrieval, searching, texts  # noqa: F401
from quern.plans.registry import QUERIES

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def coverage() -> dict[str, list[str]]:
    """Queries by the operator they cover."""
    out: dict[str, list[str]] = {}
    for name, q in QUERIES.items():
        for op in q.covers.split():
            out.setdefault(op, []).append(name)
    return out
