"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.inputs import Inputs, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *extra: tuple[str, str], recursive: bool = False, name: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under its name, with its SQL if there is one."""

    def put(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[key] = with_inputs(sql, *extra, recursive=recursive)
        return fn

    return put
