"""Every registered query of the engine's general operators, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.plans import analytics, corpus

Query = Callable[[SparkSession, str], DataFrame]
_ALL = corpus.QUERIES | analytics.QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
