"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.packing import pack, token_sizes
from graphloom.llm.registry import query, table


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text").checkpoint()
    return pack(sizes, table(spark, sf_dir, "context_budgets"))


@query("p6_containers")
def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for every budget."""
    from graphloom.llm.registry import shared_dir

    shared_dir(spark)
    return _placed(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query("p6_fill")
def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of space used of every budget."""
    from graphloom.llm.registry import shared_dir

    shared_dir(spark)
    per = _placed(spark, sf_dir).groupBy("budget_name", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return per.groupBy("budget_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("filled"))
