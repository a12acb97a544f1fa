"""Where queries and their oracle SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitspark.functions.rounding import expand_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = expand_sql(sql)
        return fn

    return keep
