"""Queries on the heavily skewed ``edges.target_name``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.skew import frequent_keys, key_percentiles, key_profile
from graphloom.plans import query
from graphloom.session import table


@query("p1_found", "SELECT target_name FROM edges WHERE target_name IS NOT NULL GROUP BY target_name HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold at least a hundredth of all rows of edges."""
    edges = table(spark, sf_dir, "edges")
    profile = key_profile(edges, "target_name", distinct=["file_id"])
    return frequent_keys(profile, edges.agg(F.count(F.lit(1)).alias("n")), 0.01).select(F.col("key").alias("target_name"))


@query(
    "p1_profile",
    """
    WITH m AS (SELECT target_name, kind, row_number() OVER (PARTITION BY target_name ORDER BY count(*) DESC, kind) AS r
               FROM edges WHERE kind IS NOT NULL GROUP BY target_name, kind)
    SELECT e.target_name, count(*) AS n_rows, count(DISTINCT source_name) AS n_sources, count(DISTINCT file_id) AS n_files,
           any_value(m.kind) AS top_kind
    FROM edges e LEFT JOIN m ON m.target_name IS NOT DISTINCT FROM e.target_name AND m.r = 1 GROUP BY e.target_name
    """,
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct sources, distinct files and most frequent kind of every target name."""
    p = key_profile(table(spark, sf_dir, "edges"), "target_name", distinct=["source_name", "file_id"], modes=["kind"])
    return p.select(F.col("key").alias("target_name"), "n_rows", F.col("distinct_source_name").alias("n_sources"), F.col("distinct_file_id").alias("n_files"), F.col("mode_kind").alias("top_kind"))


@query(
    "p1_percentiles",
    """
    SELECT target_name, quantile_disc(line, 0.5)::BIGINT AS p50, quantile_disc(line, 0.9)::BIGINT AS p90
    FROM edges WHERE line IS NOT NULL GROUP BY target_name
    """,
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and ninth decile of the line of every target name's edges."""
    return key_percentiles(table(spark, sf_dir, "edges"), "target_name", "line", [0.5, 0.9]).withColumnRenamed("key", "target_name")
