"""Keyword, fuzzy and vector retrieval, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values of the ranking: column weights, BM25's k1 and b, and the constant of reciprocal ranks
WEIGHTS = {"name": 10.0, "docstring": 2.0, "signature": 2.0, "search_text": 1.0}
K1, B, RRF_K = 1.2, 0.75, 60


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, ties by smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion of (query_id, id, rank) lists."""
    every = lists[0].select("query_id", "id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact cosine search of a stated, bounded set of query vectors against all rows.

    ``vectors`` is (id, vec), ``queries`` (query_id, vec), held in memory on every executor: at most 20,000 are taken, more
    are an error. Each partition keeps its own k best, so only k rows a query and partition are shuffled. Null, zero,
    non-finite and differently long vectors take no part.
    """
    held = queries.where(F.col("vec").isNotNull()).limit(20_001).collect()
    if len(held) > 20_000:
        raise ValueError("more than 20,000 query vectors: search in blocks")
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["vec"]) for r in held}:
        some = [(r["query_id"], np.array(r["vec"], np.float64)) for r in held if len(r["vec"]) == size and all(x is not None for x in r["vec"])]
        some = [(i, v / np.linalg.norm(v)) for i, v in some if np.isfinite(v).all() and v.any()]
        if some:
            by_size[size] = ([i for i, _ in some], np.stack([v for _, v in some]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[object, list[tuple[float, int]]] = {}
        for b in batches:
            for size, (names, q) in by_size.items():
                ok = [(i, v) for i, v in zip(b["id"], b["vec"], strict=True) if v is not None and len(v) == size]
                ok = [(i, x) for i, v in ok if np.isfinite(x := np.asarray(v, np.float64)).all() and x.any()]
                if not ok:
                    continue
                x = np.stack([v for _, v in ok])
                s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                for row, name in enumerate(names):
                    top = np.argpartition(-s[row], min(k, len(ok)) - 1)[: min(len(ok), k)] if len(ok) > k else np.arange(len(ok))
                    edge = s[row][top].min()
                    top = np.flatnonzero(s[row] >= edge)
                    merged = best.get(name, []) + [(-float(np.round(s[row][j], 9)), int(ok[j][0])) for j in top]
                    best[name] = sorted(merged)[:k]
        rows = [(n, i, -s) for n, found in best.items() for s, i in found]
        yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

    return top_k(vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInPandas(search, "query_id long, id long, score double"), k)


def damerau(a: str, b: str, limit: int) -> int:
    """Restricted Damerau-Levenshtein distance; limit+1 as soon as it must be more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def fuzzy(names: DataFrame, wanted: DataFrame, limit: int = 1) -> DataFrame:
    """(query, name, distance): distinct names within ``limit`` (0 or 1) edits of a query, by deletion neighbourhoods.

    Two words one edit or swap apart share a variant with one letter left out, so an equality join finds all candidates
    and the distance is only measured on those.
    """
    cuts = lambda c: F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c)))))
    left = wanted.select("query").where("query <> ''").distinct().select("query", F.explode(F.array_distinct(cuts("query"))).alias("v"))
    right = names.select("name").where("name <> ''").distinct().select("name", F.explode(F.array_distinct(cuts("name"))).alias("v"))
    pairs = left.join(right, "v").select("query", "name").distinct()

    @F.pandas_udf("int")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([damerau(x, y, limit) for x, y in zip(a, b, strict=True)], dtype="int32")

    return pairs.withColumn("distance", measure("query", "name")).where(F.col("distance") <= limit)
