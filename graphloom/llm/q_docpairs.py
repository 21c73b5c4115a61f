"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.docpairs import code_pairs
from graphloom.llm.registry import query, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_pairs(*(table(spark, sf_dir, t) for t in ("symbols", "files", "file_sources", "edges", "workspace_repos")))


@query("p3_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' functions and methods whose own documentation tells something (inherited text is kept elsewhere)."""
    return _pairs(spark, sf_dir).where("inherited_from IS NULL").select("file_id", "start_line").distinct()


@query("p3_pairs")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and documentation of every function and method that has one, its own or that of the method it overrides."""
    return _pairs(spark, sf_dir).where("code IS NOT NULL").dropDuplicates(["file_id", "start_line", "name"])
