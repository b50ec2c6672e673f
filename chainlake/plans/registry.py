"""Named queries and, where SQL can say the same, the statement that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Zone-less times of the tables are read as UTC, as the checking SQL does.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
