"""Queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ctes import full

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = full(sql)
        return fn

    return add


def r6(value: Column | str) -> Column:
    """Six decimals, no negative zero: what both engines agree on."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def tight(df: DataFrame) -> DataFrame:
    """All double columns to six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
