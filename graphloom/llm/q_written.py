"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.registry import query, table
from graphloom.llm.written import not_handwritten


@query("p5_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository."""
    return not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")).select(F.col("id").alias("file_id"))


@query("p5_reasons")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of these files is left out."""
    return not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")).select(F.col("id").alias("file_id"), "reason")
