"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.registry import query, table
from graphloom.llm.similar import similar_pairs, similar_vectors


@query("p2_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one model with a cosine of 0.75 or more, of which one is among the 5 most similar to the other."""
    near = similar_vectors(table(spark, sf_dir, "symbol_vectors"), "symbol_id", "model", "vector", "dim")
    return similar_pairs(near).select(F.col("a").alias("symbol_id_a"), F.col("b").alias("symbol_id_b"))


@query("p2_neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every vector, however similar, with their cosine."""
    near = similar_vectors(table(spark, sf_dir, "symbol_vectors"), "symbol_id", "model", "vector", "dim", min_similarity=None)
    return near.select(F.col("grp").alias("model"), F.col("id").alias("symbol_id"), "neighbour", F.round("similarity", 6).alias("similarity"))
