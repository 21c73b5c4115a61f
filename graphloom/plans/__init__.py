"""Registered queries: a function and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL it must agree with."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that is one ANSI statement over tables written as {table}; the same text serves as its SQL."""
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from graphloom.session import table

        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})

    QUERIES[name] = run
    SQL[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", text)
