"""Per-key statistics that stay balanced when a few keys hold most records.

Value-frequency compression: rows are first counted per (key, value), which map-side combining does before any row is
shuffled and which spreads a hot key over as many reducers as it has values; only those counts are grouped by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut


def value_frequencies(df: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Rows (key, *carry, col, value, n): how often each value of each column occurs under each key.

    Values are compared as strings. A null value is kept as a row with a null ``value``, a null key is a key of its
    own, repeated rows count as often as they occur, and an empty table gives no rows. Columns of ``df`` that are not
    named are not read, so clashing names cannot matter.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return (
        df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`") for c in carry], F.explode(pairs).alias("p"))
        .groupBy("key", *carry, F.col("p.col").alias("col"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def key_profile(df: DataFrame, key: str, distinct: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """Rows (key, n_rows, distinct_<c>..., mode_<c>...), one for each key, exact.

    ``distinct_c`` counts the non-null values of ``c``; ``mode_c`` is the most frequent non-null value, the smallest of
    those that tie, and null where all are null. Null keys form one key; an empty table gives no rows.
    """
    columns = list(dict.fromkeys([*distinct, *modes]))
    freq = value_frequencies(df, key, columns)
    known = F.col("value").isNotNull()

    def of(c: str) -> Column:
        return F.col("col") == c

    aggs = [F.sum(F.when(of(columns[0]), F.col("n"))).alias("n_rows")]
    aggs += [F.count(F.when(of(c) & known, 1)).alias(f"distinct_{c}") for c in distinct]
    # among the most frequent the smallest: min over the values of the highest count needs two orders in one struct
    for c in modes:
        order = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
        aggs.append(F.min(F.when(of(c) & known, order)).getField("value").alias(f"mode_{c}"))
    return freq.groupBy("key").agg(*aggs)


def key_percentiles(df: DataFrame, key: str, column: str, fractions: Sequence[float]) -> DataFrame:
    """Rows (key, p<percent>...): exact lower percentiles (the value of rank ceil(f*n)) of an integer column per key.

    The weighted values are partitioned by ranges of (key, value), which are distinct, so that a hot key is spread over
    many partitions however its values lie; the sums of each partition (one row a key and partition) tell in which the
    wanted rank is, and only there are values looked at one by one. Nulls are left out; keys with nothing but nulls do
    not come out; a null key is a key of its own.
    """
    v = F.col("v")
    freq = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("long").alias("v")).where(v.isNotNull()).groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    # the cut keeps the ranges as they are: drawn again they could differ
    parts = cut(freq.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("key", "part").agg(F.sum("n").alias("bn"))
    same = Window.partitionBy("key").orderBy("part")
    upto = sums.withColumn("upto", F.sum("bn").over(same.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("bn").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wanted = [F.greatest(F.ceil(F.lit(f) * F.col("total")).cast("long"), F.lit(1)) for f in fractions]
    hit = F.array_compact(F.array(*[F.when((w <= F.col("upto")) & (w > F.col("upto") - F.col("bn")), F.struct(F.lit(i).alias("i"), (w - F.col("upto") + F.col("bn")).alias("rank"))) for i, w in enumerate(wanted)]))
    hits = upto.select(F.col("key").alias("k2"), F.col("part").alias("p2"), F.explode(hit).alias("h"))
    inside = parts.join(hits, F.col("key").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("p2")))
    within = Window.partitionBy("key", "part", "h.i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("r", F.sum("n").over(within)).where(F.col("r") >= F.col("h.rank"))
    return found.groupBy("key").agg(*[F.min(F.when(F.col("h.i") == i, v)).alias(f"p{round(f * 100)}") for i, f in enumerate(fractions)])


def frequent_keys(profile: DataFrame, total: DataFrame, share: float) -> DataFrame:
    """The non-null keys of ``profile`` that hold at least ``share`` of the rows that ``total`` (one row, ``n``) counts."""
    return profile.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * total.select("n").scalar()))


def salted_group(df: DataFrame, key: str, salts: int, partial: Sequence[Column], final: Sequence[Column], salt: Column | None = None) -> DataFrame:
    """Two-stage grouping for aggregates without map-side combine: by (key, salt), then by key."""
    s = salt if salt is not None else F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    return df.groupBy(key, s.alias("_salt")).agg(*partial).groupBy(key).agg(*final)


def any_of(conditions: Sequence[Column]) -> Column:
    """The disjunction of conditions, false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
