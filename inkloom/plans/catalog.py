"""Registry of queries: a Spark callable over the adapter views and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.plans.views import Views
from inkloom.plans.views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(views)`` under ``name``; ``sql`` may use the listed adapter views."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Views(spark, directory))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
