"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.leakage import leaks
from graphloom.llm.registry import query, table


@query("p7_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item, wholly or partly, with the item."""
    rows = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return rows.where(F.col("kind") == "passage").select("item_id", "doc_id")


@query("p7_leaks")
def all_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with paraphrases, and with what kind of leak it is."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
