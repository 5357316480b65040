"""Registered queries: name -> (Spark callable, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, lists: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``lists`` names string arrays, which are compared as joined text."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def joined(spark: SparkSession, source: str) -> DataFrame:
            df = fn(spark, source)
            return df.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns])

        QUERIES[name] = joined if lists else fn
        if oracle is not None:
            swaps = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in lists)
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({oracle})" if lists else oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison, without a negative zero."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "double" and name not in keep:
            return (F.round(c, digits) + F.lit(0.0)).alias(name)
        return c

    return df.select(*[shown(n, k) for n, k in df.dtypes])
