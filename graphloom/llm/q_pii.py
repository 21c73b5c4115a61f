"""Queries of problem 8."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.pii import find_pii, masked
from graphloom.llm.registry import query, table


@query("p8_found")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address, phone number, identity number, postal address and personal name, with its place."""
    return find_pii(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "start_pos", "end_pos", "pii_type")


@query("p8_masked")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with typed placeholders. The key is GRAPHLOOM_PII_KEY, or the session's spark.graphloom.pii.key; without
    either a key is drawn for this run, so that pseudonyms link within it and to nothing else."""
    key = os.environ.get("GRAPHLOOM_PII_KEY") or spark.conf.get("spark.graphloom.pii.key", "") or secrets.token_hex(32)
    return masked(table(spark, sf_dir, "documents"), key.encode()).withColumnRenamed("id", "doc_id")
