"""Registry of named queries (Spark callable + optional DuckDB oracle SQL).

``__spark_entry__.queries()`` / ``oracle_sql()`` read these two dicts.  Each
Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from monthpick.plans import (  # noqa: F401
        q_labels,
        q_features,
        q_selection,
        q_metrics,
        q_ml,
        q_io,
    )
