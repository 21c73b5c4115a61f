"""Tables on disk that are changed key by key: buckets of Parquet files, of which only those with changed keys are rewritten.

Rows are spread over ``buckets`` folders by a hash of their key. A change reads the touched buckets, leaves out the changed
keys' rows, adds the new ones, writes the result beside the table and then puts it in place of the touched buckets. It is
idempotent, so a stream may repeat a batch. One writer at a time is assumed, as for any table of plain files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A new table at ``path``; whatever is there is replaced."""
    _bucketed(df, key, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BUCKET)


def change(path: str, key: str, gone: DataFrame, fresh: DataFrame | None = None, buckets: int = 64) -> int:
    """Takes away the rows of the keys in ``gone`` (key) and of those in ``fresh``, and adds ``fresh``; how many buckets were touched.

    Columns that only one side has are null on the other. Null keys are keys like others. Without any key nothing happens.
    """
    spark = gone.sparkSession
    keys = gone.select(F.col(key).cast("string").alias("_k"))
    if fresh is not None:
        keys = keys.union(fresh.select(F.col(key).cast("string")))
    keys = keys.distinct()
    touched = [r[0] for r in keys.select(F.pmod(F.xxhash64("_k"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    fs, root = _fs(spark, path)
    new = None if fresh is None else _bucketed(fresh, key, buckets)
    if fs.exists(root) and any(x.getPath().getName().startswith(BUCKET) for x in fs.listStatus(root)):
        old = spark.read.option("mergeSchema", "true").parquet(path).where(F.col(BUCKET).isin(touched))
        kept = old.join(keys, old[key].cast("string").eqNullSafe(F.col("_k")), "left_anti")
        rows = kept if new is None else kept.unionByName(new, allowMissingColumns=True)
    elif new is None:
        return 0
    else:  # a table without rows has no files to read
        rows = new
    staged = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(staged)
    for b in touched:
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        new = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}/{BUCKET}={b}")
        fs.delete(part, True)
        if fs.exists(new):
            fs.rename(new, part)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    spark.catalog.refreshByPath(path)
    return len(touched)


def put_channel(df: DataFrame, path: str, channel: str) -> None:
    """Replaces the rows of one channel (synthesised edges, test edges, ...) of a table partitioned by channel, no others."""
    df.withColumn("channel", F.lit(channel)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel").parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def handler(path: str, key: str, deleted: str | None = None, buckets: int = 64):
    """A function for ``foreachBatch``: rows whose column ``deleted`` is true take their key away, all others replace it."""

    def apply(batch: DataFrame, _: int) -> None:
        gone = batch.where(F.coalesce(F.col(deleted), F.lit(False))) if deleted else batch.limit(0)
        fresh = batch.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else batch
        change(path, key, gone.select(key), fresh, buckets)

    return apply


def as_json(df: DataFrame) -> DataFrame:
    """(value): every row as a line of JSON; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_lines(df: DataFrame, column: str) -> DataFrame:
    """(value): one column as text lines, without nulls."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))


def append_slow(calls: DataFrame, path: str, threshold_ms: float = 100.0) -> None:
    """Appends the calls (tool, elapsed_ms, ...) that took at least so long, as lines of JSON."""
    calls.where(F.col("elapsed_ms") >= threshold_ms).withColumn("event", F.lit("slow_query")).write.mode("append").json(path)
