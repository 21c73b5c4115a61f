"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.grammar import GRAMMARS
from graphloom.llm.parse import broken_files, language_name
from graphloom.llm.registry import query, table
from graphloom.operators.repos import owned


@query("p4_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text does not parse in their language."""
    return broken_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")).select(F.col("id").alias("file_id"))


def _rates(spark: SparkSession, sf_dir: str, claimed: bool) -> DataFrame:
    files, sources, repos = (table(spark, sf_dir, t) for t in ("files", "file_sources", "workspace_repos"))
    judged = files.where(F.col("language").isin(list(GRAMMARS))).join(sources.where(F.col("text").isNotNull()).select("path"), "path", "left_semi")
    judged = judged.join(broken_files(files, sources).select("id", F.lit(1).alias("broken")), "id", "left")
    owned_files = judged.join(owned(files, repos).select("id", "repo_alias"), "id")
    if claimed:
        claims = table(spark, sf_dir, "suspect_candidates").select(F.col("file").alias("path"), language_name(F.col("language")).alias("language")).distinct()
        owned_files = owned_files.drop("language").join(claims, "path")
    out = owned_files.groupBy("repo_alias", "language").agg(F.count(F.lit(1)).alias("files"), F.count("broken").alias("broken"))
    return out.withColumn("share", F.round(F.col("broken") / F.col("files"), 6))


@query("p4_rates")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a text, those that do not parse and their share, per repository (null: under no root) and language.

    Files of a language without a grammar here are not judged and so not counted.
    """
    return _rates(spark, sf_dir, False)


@query("p4_rates_claimed")
def rates_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per repository and language as claimed in suspect_candidates, in its usual spelling."""
    return _rates(spark, sf_dir, True)
