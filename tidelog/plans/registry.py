"""Registry of named queries: Spark callable, survey id, and SQL where one can state the result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}

# Tables settled by the running query and shared by its parts; emptied when a query starts.
SHARED: dict[tuple, DataFrame] = {}


def query(name: str, survey_id: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            SHARED.clear()
            return fn(spark, folder)

        QUERIES[name] = run
        SURVEY_IDS[name] = survey_id
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(col: str | Column, name: str | None = None) -> Column:
    """Round a float for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or str(col))
