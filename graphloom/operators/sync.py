"""Incremental upkeep: comparing snapshots, replacing the rows of changed files, budgets on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, removed, modified or unchanged. Null keys are left out; a null digest differs from all but null."""
    a = stored.where(F.col(key).isNotNull()).select(key, F.col(digest).alias("_old"), F.lit(True).alias("_a")).dropDuplicates([key])
    b = current.where(F.col(key).isNotNull()).select(key, F.col(digest).alias("_new"), F.lit(True).alias("_b")).dropDuplicates([key])
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def replace_rows(table: DataFrame, fresh: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table without the rows of changed or removed keys, and with the fresh ones; both need the same columns."""
    gone = changes.where("status <> 'unchanged'").select(key)
    return table.join(gone, key, "left_anti").unionByName(fresh.join(gone, key, "left_semi"), allowMissingColumns=True)


def rebase(files: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Paths below one root moved below another; pseudo files, whose path starts with a colon, stay."""
    return files.withColumn("path", F.when(F.startswith("path", F.lit(old_root.rstrip("/") + "/")), F.concat(F.lit(new_root.rstrip("/")), F.substring("path", len(old_root.rstrip("/")) + 1, 1 << 30))).otherwise(F.col("path")))


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose summed sizes fit; after the first overflow nothing is kept."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(F.coalesce(size, F.lit(0))).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def innermost(points: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """(point, span): for each point (point, file_id, line) the smallest of the spans (span, file_id, start_line, end_line) it lies
    in, of equals the one with the smallest id. Spans are cut into blocks of lines, so that a point meets only those near it."""
    s = spans.where("end_line >= start_line").withColumn("b", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))))
    p = points.withColumn("b", F.floor(F.col("line") / block))
    met = p.join(s, ["file_id", "b"]).where("line BETWEEN start_line AND end_line")
    return met.groupBy("point").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "span"))["span"].alias("span"))
