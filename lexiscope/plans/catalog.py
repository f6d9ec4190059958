"""Query catalogue: every registered query reads the driver tables (through
the fixture views) and returns a DataFrame; ``ORACLE`` holds the DuckDB SQL
for the same result where one exists (SURVEY §2 oracle column D)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from lexiscope.plans import (  # noqa: F401
        q_evaluation, q_text, q_sampling, q_profile, q_features, q_graph, q_models, q_sources,
        q_multiclass)
