"""The engine's queries on the shared tables, each with the DuckDB SQL that says what it must give.

The tables stand in for telemetry: ``events`` are frames (a user is a session, the event type an action, the value a norm),
``conversations`` are chained sessions, ``documents`` payloads on disk with ``labels`` as their log, ``lineitem`` record
streams with gaps, and the order tables claims, entities, lineage, publishers and trust anchors.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is one that SQL can't express."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import evidence, graphs, streams, telemetry  # noqa: E402, F401  they register their queries
