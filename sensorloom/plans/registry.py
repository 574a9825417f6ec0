"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: fn(tune(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into a plain one."""
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS) + F.lit(0.0)


def sql_r6(expression: str) -> str:
    return f"(round({expression}, {DIGITS}) + 0.0)"


def rounded(df: DataFrame) -> DataFrame:
    """All floats of a result rounded, infinities left as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.abs(c) == float("inf"), c).otherwise(r6(c)).alias(f.name)
        out.append(c)
    return df.select(*out)


def load_all() -> None:
    from sensorloom.plans import (  # noqa: F401
        q_aggregates,
        q_joins,
        q_models,
        q_rows,
        q_sources,
        q_windows,
    )
