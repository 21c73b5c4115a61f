"""Which repository a file belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, path, repo_alias, rest): each file with the repository whose root its path starts with, the deepest of several roots.

    ``rest`` is the path below the root. Files under no root have a null ``repo_alias`` and ``rest``; null paths are under none. A root is a path's first folders, as many as
    the root has, so that the join is an equality for each depth of root (a handful), not a scan of all roots.
    """
    roots = repos.where("repo_root IS NOT NULL").select(F.regexp_replace("repo_root", "/+$", "").alias("root"), "repo_alias").groupBy("root").agg(F.min("repo_alias").alias("repo_alias"))
    deep = [r[0] for r in roots.select(F.size(F.split("root", "/")).alias("n")).distinct().orderBy("n").collect()]  # as many as roots have depths
    if not deep:
        return files.select("id", "path", F.lit(None).cast("string").alias("repo_alias"), F.lit(None).cast("string").alias("rest"))
    parts = F.split("path", "/")
    keys = F.array_distinct(F.array(*[F.concat_ws("/", F.slice(parts, 1, n)) for n in deep]))
    placed = files.where("path IS NOT NULL").select("id", F.explode(keys).alias("root")).join(roots, "root")
    best = placed.groupBy("id").agg(F.max_by(F.struct("repo_alias", "root"), F.length("root")).alias("b"))
    rest = F.expr("substring(path, length(b.root) + 2)")
    return files.select("id", "path").join(best, "id", "left").select("id", "path", F.col("b.repo_alias").alias("repo_alias"), rest.alias("rest"))
