"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Dataset under its own name."""

    def add(f: Callable[[Dataset], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Dataset(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
