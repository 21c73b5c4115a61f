"""Streams: sessions of tool calls with late data, and per-key debouncing into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def calls_stream(spark: SparkSession, path: str) -> DataFrame:
    """The tool calls below ``path`` as a stream, in files' order."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path + "*")  # as a pattern, a single file will do


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "7 days", key: str = "session_id") -> DataFrame:
    """(key, started, ended, calls): runs of calls with no pause of ``gap``; batch and stream alike.

    A call repeated under a new id counts once, as (session, ts, tool, event) is the same; calls later than ``late``
    behind the newest are given up by a stream. Null keys and times are left out.
    """
    at = F.timestamp_micros((F.col("ts") * 1e6).cast("long"))
    rows = calls.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("at", at)
    if rows.isStreaming:
        rows = rows.withWatermark("at", late).dropDuplicates([key, "at", "tool", "event"])
    else:
        rows = rows.dropDuplicates([key, "at", "tool", "event"])
    grouped = rows.groupBy(key, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("calls"), F.min("at").alias("started"), F.max("at").alias("ended"))
    return grouped.select(key, "started", "ended", "calls")


def upsert_stream(events: DataFrame, checkpoint: str, key: str, order: str | list[str], apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Debounced upserts: of each micro-batch only the newest row of every key reaches ``apply``, which must be idempotent
    for a batch id, as a batch is repeated after a failure."""

    def batch(df: DataFrame, number: int) -> None:
        newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*([order] if isinstance(order, str) else order))).alias("r")).select("r.*")
        apply(newest, number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
