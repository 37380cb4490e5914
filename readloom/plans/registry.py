"""The list of registered queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str, sql: str | None = None):
    """Register a function of DataFrames, one for each named view; ``sql`` runs over the same views."""
    names = views.split()

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql is not None:
            SQL[f.__name__] = oracle(names[0], sql, *names[1:])
        return f

    return add
