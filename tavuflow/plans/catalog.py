"""Queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tavuflow.plans import evaluation, experiment, files, labels, models, parsing, results, tokens

_MODULES = (tokens, labels, evaluation, results, parsing, models, files, experiment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
