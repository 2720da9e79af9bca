"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.functions.columns import ident
from movecheck.operators.policy import register
from movecheck.sources.tables import run_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with its oracle if there is one."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_sql(spark: SparkSession, sf: str, text: str, tables: Sequence[str]) -> DataFrame:
    """SQL text over the named tables, registered without their blocked columns."""
    for name in tables:
        register(table(spark, sf, name), name)
    return run_query(spark, text)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, so that summation order cannot show."""
    return df.select(
        *[
            F.round(ident(name), digits).alias(name) if kind == "double" else ident(name)
            for name, kind in df.dtypes
        ]
    )
