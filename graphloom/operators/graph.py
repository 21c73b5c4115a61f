"""Graph operators over name-keyed edges: level-synchronous loops of joins, each level cut by a reliable checkpoint.

Edges are reduced to distinct (source_name, target_name, kind) rows before any loop, so that the duplicates of a hub do
not multiply. A loop only asks for the size of a frontier, never for its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rules import module_folder
from graphloom.functions.text import CONTAINERS, bare_name, is_test_path
from graphloom.session import cut

#: fixed value: kinds that carry no impact
NO_IMPACT = ("raises", "catches", "tests")


#: rows of a frontier that are sent to every executor; larger ones are joined by shuffling
SMALL = 100_000


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, marked to be sent to every executor if it has at most ``SMALL`` rows, and how many it has."""
    n = df.count()
    return (F.broadcast(df) if n <= SMALL else df), n


def adjacency(edges: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (src, dst, kind, synthesized_by) rows without self edges, null ends and excluded kinds."""
    by = F.col("synthesized_by") if "synthesized_by" in edges.columns else F.lit(None).cast("string").alias("synthesized_by")
    e = edges.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"), "kind", by).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return (e.where(~F.col("kind").isin(*exclude)) if exclude else e).distinct()


def resolved(adj: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges with ``rank``: the confidence by how many symbols bear the target's name: one 2, none 1, several 0.

    The counts are joined to the distinct edges; a hub's edges are one partition of that join, which the adaptive
    skew join splits, as the other side has one row a name.
    """
    counts = symbols.groupBy(F.col("name").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("n").isNull(), 1).when(F.col("n") == 1, 2).otherwise(0)
    return adj.join(counts, "dst", "left").select(*adj.columns, rank.alias("rank"))


def walk(hops: DataFrame, seeds: DataFrame, direction: str = "upstream", depth: int = 3) -> DataFrame:
    """(name, distance, rank, kind, synthesized_by): names reached from the seeds within ``depth`` hops, at their least
    distance.

    The rank of a path is its weakest hop, a name's rank the strongest of its paths of least distance; kind and
    provenance are those of the last hop of that path, the first by (parent, kind, provenance) of equals. Seeds are never
    returned, not even through a cycle; null seeds are ignored; without seeds nothing is reached.
    """
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    kind = F.col("kind") if "kind" in hops.columns else F.lit(None).cast("string").alias("kind")
    by = F.col("synthesized_by") if "synthesized_by" in hops.columns else F.lit(None).cast("string").alias("synthesized_by")
    steps = hops.select(F.col(near).alias("name"), F.col(far).alias("to"), F.col("rank").alias("hop"), kind, by)
    nothing = F.lit(None).cast("string")
    seen = cut(seeds.select("name").where("name IS NOT NULL").distinct().select("name", F.lit(0).alias("distance"), F.lit(2).alias("rank"), nothing.alias("kind"), nothing.alias("synthesized_by")))
    frontier, _ = sized(seen)
    best = F.min(F.struct((-F.least("rank", "hop")).alias("r"), F.col("name").alias("p"), F.col("kind"), F.col("synthesized_by"))).alias("b")
    for level in range(1, depth + 1):
        reached = steps.join(frontier.select("name", "rank"), "name").groupBy(F.col("to").alias("name")).agg(best)
        fresh = reached.join(seen.select("name"), "name", "left_anti")
        fresh = cut(fresh.select("name", F.lit(level).alias("distance"), (-F.col("b.r")).alias("rank"), "b.kind", "b.synthesized_by"))
        frontier, n = sized(fresh)
        if not n:
            break
        seen = seen.unionByName(fresh)
    return seen.where("distance > 0")


def impact(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(name, distance, rank, tier) upstream of the seeds, without kinds that carry no impact."""
    return walk(resolved(adjacency(edges, NO_IMPACT), symbols), seeds, "upstream", depth).select("name", "distance", "rank", tier("distance").alias("tier"))


def tier(distance: str) -> Column:
    """The risk tier of a distance."""
    return F.when(F.col(distance) <= 1, "will_break").when(F.col(distance) == 2, "likely_affected").otherwise("may_need_testing")


def _links(symbols: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The wanted names, their first definition's kind, and the dotted symbol names with their first and last part."""
    wanted = names.select("name").where("name IS NOT NULL AND name <> ''").distinct()
    first = symbols.select("name", "id", "kind").join(wanted, "name", "left_semi").groupBy("name").agg(F.min_by("kind", "id").alias("kind"))
    dotted = symbols.select("name").where("name LIKE '%.%'").distinct()
    dotted = dotted.select(F.col("name").alias("full"), F.substring_index("name", ".", 1).alias("owner"), bare_name(F.col("name")).alias("bare"))
    return wanted, first, dotted


def aliases(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, match): under which names the edges of a name are to be looked up.

    Every name itself; a dotted name also by its last part; a container also by the last parts of its members.
    """
    wanted, first, dotted = _links(symbols, names)
    own = wanted.select("name", F.col("name").alias("match"))
    bare = wanted.where("name LIKE '%.%'").select("name", bare_name(F.col("name")).alias("match")).where("match <> ''")
    plain = first.where(F.col("kind").isin(*CONTAINERS) & ~F.col("name").contains("."))
    members = dotted.join(plain.select(F.col("name").alias("owner")), "owner").select(F.col("owner").alias("name"), F.col("bare").alias("match"))
    return own.unionByName(bare).unionByName(members.where("match <> ''")).distinct()


def seeds_of(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, match): from which names the walk of a name starts: as ``aliases``, members also by their full name, and a
    plain name without a definition of its own also by the dotted names that end with it."""
    wanted, first, dotted = _links(symbols, names)
    plain = first.where(F.col("kind").isin(*CONTAINERS) & ~F.col("name").contains("."))
    members = dotted.join(plain.select(F.col("name").alias("owner")), "owner").select(F.col("owner").alias("name"), F.col("full").alias("match"))
    loose = wanted.where(~F.col("name").contains(".")).join(first.select("name"), "name", "left_anti")
    ends = dotted.join(loose.select(F.col("name").alias("bare")), "bare").select(F.col("bare").alias("name"), F.col("full").alias("match"))
    return aliases(symbols, names).unionByName(members).unionByName(ends).distinct()


def test_only_stems(files: DataFrame) -> DataFrame:
    """(name): file names without suffix that only test files bear."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    f = files.where("path NOT LIKE ':%'").select(stem.alias("name"), is_test_path(F.col("path")).alias("t")).distinct()
    return f.groupBy("name").agg(F.bool_and("t").alias("t")).where("t").select("name")


def blast_radius(edges: DataFrame, symbols: DataFrame, files: DataFrame, target: str, direction: str = "both", depth: int = 3, include_tests: bool = True) -> DataFrame:
    """(direction, name, distance, rank, tier, path, is_test, kind, synthesized_by) around a target and its other names.

    ``path`` is the first path that defines the name, null for none; a name is a test's by that path or, without one, if
    only test files are called like it. Without ``include_tests`` those rows are left out (count them by asking for
    them). A target that nothing knows has no rows; depth is kept between 1 and 10.
    """
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(f"direction is upstream, downstream or both, not {direction}")
    depth = min(10, max(1, depth))
    spark = edges.sparkSession
    start = seeds_of(symbols, spark.createDataFrame([(target,)], "name string")).select(F.col("match").alias("name"))
    hops = resolved(adjacency(edges, NO_IMPACT), symbols)
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    reached = [walk(hops, start, w, depth).withColumn("direction", F.lit(w)) for w in ways]
    rows = reached[0] if len(reached) == 1 else reached[0].unionByName(reached[1])
    paths = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("name").agg(F.min("path").alias("path"))
    stems = test_only_stems(files).withColumn("only", F.lit(True))
    rows = rows.join(paths, "name", "left").join(stems, "name", "left")
    is_test = F.coalesce(is_test_path(F.col("path")), F.col("only"), F.lit(False))
    rows = rows.select("direction", "name", "distance", "rank", tier("distance").alias("tier"), "path", is_test.alias("is_test"), "kind", "synthesized_by")
    return rows if include_tests else rows.where("NOT is_test")


def risk_summary(radius: DataFrame, cap: int = 25) -> DataFrame:
    """(direction, tier, entries, shown, dropped): counted before a list of at most ``cap`` entries a tier is made."""
    counts = radius.groupBy("direction", "tier").agg(F.count(F.lit(1)).alias("entries"))
    return counts.select("direction", "tier", "entries", F.least("entries", F.lit(cap)).alias("shown"), F.greatest(F.col("entries") - cap, F.lit(0)).alias("dropped"))


def relevant(radius: DataFrame, target: str, cap: int = 25) -> DataFrame:
    """The rows of a radius to show: of each direction and tier at most ``cap``, others' names before the target's own
    container and members, production before tests, then by distance and name; with their ``place``."""
    owner = target.rsplit(".", 1)[0] if "." in target else target
    own = (F.substring_index("name", ".", 1) == owner.split(".")[0]) & F.col("name").startswith(owner)
    order = Window.partitionBy("direction", "tier").orderBy(own, "is_test", "distance", "name")
    return radius.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def trace(adj: DataFrame, source: str, target: str | list[str], depth: int = 10) -> DataFrame:
    """(hop, src, dst, kind): one shortest path from source to target.

    ``target`` may be several names for one, the first being what the last hop is renamed to. Every name keeps one parent
    of the level before, the first by (parent, kind), so the state is a row a name, not a row a path; of several names
    of the target that are reached at once the first counts. The same name for both ends, or no path within ``depth``,
    gives no rows.
    """
    spark = adj.sparkSession
    wanted = [target] if isinstance(target, str) else list(target)
    empty = spark.createDataFrame([], "hop int, src string, dst string, kind string")
    if source in wanted:
        return empty
    steps = adj.select("src", "dst", "kind").distinct()
    seen = cut(spark.createDataFrame([(source, None, None, 0)], "name string, parent string, kind string, distance int"))
    frontier, found, end = F.broadcast(seen), 0, ""
    for level in range(1, depth + 1):
        parents = steps.join(frontier.select(F.col("name").alias("src")), "src").groupBy(F.col("dst").alias("name")).agg(F.min(F.struct("src", "kind")).alias("p"))
        fresh = cut(parents.join(seen.select("name"), "name", "left_anti").select("name", F.col("p.src").alias("parent"), F.col("p.kind").alias("kind"), F.lit(level).alias("distance")))
        frontier, n = sized(fresh)
        if not n:
            break
        seen = seen.unionByName(fresh)
        hit = fresh.where(F.col("name").isin(wanted)).agg(F.min("name")).first()[0]
        if hit is not None:
            found, end = level, hit
            break
    rows, name = [], end
    for hop in range(found, 0, -1):  # at most ``depth`` single rows
        row = seen.where((F.col("name") == name) & (F.col("distance") == hop)).select("parent", "kind").first()
        rows.append((hop, row["parent"], wanted[0] if hop == found else name, row["kind"]))
        name = row["parent"]
    return spark.createDataFrame(rows, "hop int, src string, dst string, kind string") if rows else empty


def trace_by_names(edges: DataFrame, symbols: DataFrame, source: str, target: str, depth: int = 10) -> DataFrame:
    """``trace`` to any other name of the target; without a path also from the dotted names that end with the source."""
    spark = edges.sparkSession
    ends = seeds_of(symbols, spark.createDataFrame([(target,)], "name string")).select("match").limit(10_000).collect()
    goals = [target, *sorted({r["match"] for r in ends} - {target})]
    adj = cut(adjacency(edges))
    path = trace(adj, source, goals, depth)
    if "." in source or not path.isEmpty():
        return path
    starts = symbols.where(F.col("name").endswith("." + source)).select("name").distinct().orderBy("name").limit(25).collect()
    for r in starts:
        if not (path := trace(adj, r["name"], goals, depth)).isEmpty():
            break
    return path


def callers(adj: DataFrame, names: DataFrame) -> DataFrame:
    """(name, caller, kind) of one hop."""
    return adj.join(names.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("name"), F.col("src").alias("caller"), "kind").distinct()


def callees(adj: DataFrame, names: DataFrame) -> DataFrame:
    """(name, callee, kind) of one hop."""
    return adj.join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("name"), F.col("dst").alias("callee"), "kind").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(name, component): the smallest name of each connected component, by alternating large and small stars.

    Every round halves distances roughly, so rounds grow with the logarithm of the diameter. It ends when nothing changes.
    """
    links = cut(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    names = pairs.select(F.col("src").alias("name")).union(pairs.select("dst")).where("name IS NOT NULL").distinct()
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        after = mark(links)
        if after == before:
            break
        before = after
    return names.join(links.select(F.col("u").alias("name"), F.col("v").alias("c")), "name", "left").groupBy("name").agg(F.min(F.coalesce("c", "name")).alias("component"))


def pagerank(adj: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(name, score): personalised PageRank over directed edges; the mass of names without an out-edge returns to the seeds.

    Scores sum to 1. Without seeds among the names nothing comes out. A round is one job, and one more where some
    names have no out-edge; whether the scores have settled is looked at every fifth round.
    """
    steps = cut(adj.select("src", "dst").distinct())
    out = steps.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    spread = cut(steps.join(out, "src").select(F.col("src").alias("name"), "dst", (1 / F.col("out")).alias("w")))
    names = steps.select(F.col("src").alias("name")).union(steps.select("dst")).distinct()
    start = seeds.select("name").distinct().join(names, "name", "left_semi")
    n = start.count()
    if not n:
        return start.select("name", F.lit(0.0).alias("score")).limit(0)
    base = cut(names.join(start.withColumn("s", F.lit(1.0 / n)), "name", "left").join(out.select(F.col("src").alias("name"), F.lit(1).alias("has")), "name", "left").select("name", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("has").isNotNull().alias("has")))
    scores = base.select("name", F.col("s").alias("score"))
    all_lead_on = base.where("NOT has").isEmpty()
    for r in range(1, rounds + 1):
        flow = scores.join(spread, "name").groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("flow"))
        lost = 0.0 if all_lead_on else scores.join(base.where("NOT has"), "name", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        fresh = base.join(flow, base["name"] == flow["dst"], "left")
        fresh = cut(fresh.select(base["name"], ((1 - restart) * (F.coalesce("flow", F.lit(0.0)) + F.lit(lost) * F.col("s")) + restart * F.col("s")).alias("score")))
        moved = fresh.withColumnRenamed("score", "new").join(scores, "name").agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0] if r % 5 == 0 else None
        scores = fresh
        if moved is not None and moved < tolerance:
            break
    return scores


def local_subgraph(adj: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 500) -> DataFrame:
    """(name, distance): at most ``most`` names around the seeds, edges taken both ways, level by level; where a level
    does not fit its first names do."""
    both = adj.select(F.col("src").alias("name"), F.col("dst").alias("to")).union(adj.select(F.col("dst"), F.col("src"))).distinct()
    seen = cut(seeds.select("name").where("name IS NOT NULL").distinct().orderBy("name").limit(most).select("name", F.lit(0).alias("distance")))
    frontier, left = F.broadcast(seen), most - seen.count()
    for level in range(1, depth + 1):
        if left <= 0:
            break
        near = both.join(frontier.select("name"), "name").select(F.col("to").alias("name")).distinct().join(F.broadcast(seen.select("name")), "name", "left_anti")
        fresh = cut(near.orderBy("name").limit(left).select("name", F.lit(level).alias("distance")))
        n = fresh.count()
        if not n:
            break
        seen, frontier, left = seen.unionByName(fresh), F.broadcast(fresh), left - n
    return seen


def relevance(adj: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 500, restart: float = 0.15, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(name, score): personalised PageRank over the undirected graph of at most ``most`` names around the seeds.

    The mass of names without neighbours returns to the seeds; scores sum to 1; without seeds in the graph nothing comes
    out. The subgraph is found by joins and is bounded, so it is ranked in one task.
    """
    near = F.broadcast(local_subgraph(adj, seeds, depth, most).select("name"))
    inner = adj.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inner = inner.join(near.select(F.col("name").alias("a")), "a", "left_semi").join(near.select(F.col("name").alias("b")), "b", "left_semi")
    first = [r["name"] for r in seeds.select("name").where("name IS NOT NULL").distinct().orderBy("name").limit(most).collect()]

    def rank(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*p["a"], *p["b"]})
        at = {n: i for i, n in enumerate(names)}
        i, j = p["a"].map(at).to_numpy(), p["b"].map(at).to_numpy()
        src, dst = np.r_[i, j], np.r_[j, i]
        start = np.array([float(n in here) for n in names]) if (here := {*first} & {*names}) else np.zeros(len(names))
        if not start.any():
            return pd.DataFrame({"name": [], "score": []})
        start /= start.sum()
        degree, score = np.bincount(src, minlength=len(names)), start.copy()
        for _ in range(rounds):
            flow = np.bincount(dst, score[src] / degree[src], minlength=len(names))
            new = (1 - restart) * flow + (restart + (1 - restart) * score[degree == 0].sum()) * start
            moved, score = np.abs(new - score).sum(), new
            if moved < tolerance:
                break
        return pd.DataFrame({"name": names, "score": score})

    return inner.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda p: rank(p), "name string, score double")


def _louvain(a: np.ndarray, b: np.ndarray, sweeps: int = 100, block: int = 256) -> np.ndarray:
    """The community of every name by the local-moving phase of Louvain, name by name in the order of their numbers, ties to
    the smaller label; a link is given once, every number from 0 on has one. Gains are compared as integers (times the links
    and twice their number).

    A block of names is first judged at once; from its first name that moves on, it is taken name by name. That is the same
    as taking all by themselves, as nothing moves before.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    n, m2 = int(max(a.max(), b.max())) + 1, 2 * len(a)
    near = np.concatenate([b, a])[np.argsort(np.concatenate([a, b]), kind="stable")]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    first = np.concatenate([[0], np.cumsum(degree)])
    label, total = np.arange(n), degree.copy()
    labels, totals, degrees = label.tolist(), total.tolist(), degree.tolist()  # for the names taken by themselves

    def first_to_move(lo: int, hi: int) -> int:
        own, deg = label[lo:hi], degree[lo:hi]
        key, inside = np.unique(np.repeat(np.arange(hi - lo), deg) * n + label[near[first[lo] : first[hi]]], return_counts=True)
        at, c = np.divmod(key, n)
        home = c == own[at]
        cost = (total[c] - deg[at] * home) * deg[at] - inside * m2
        stay = (total[own] - deg) * deg
        stay[at[home]] = cost[home]
        can = np.flatnonzero((cost < stay[at]) | (cost == stay[at]) & (c < own[at]))
        return lo + int(at[can[0]]) if len(can) else hi

    for _ in range(sweeps):
        moved = False
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            start, p = first_to_move(lo, hi), 0
            ends = near[first[start] : first[hi]].tolist()
            for i in range(start, hi):
                d, own = degrees[i], labels[i]
                inside = {own: 0}
                for x in ends[p : p + d]:
                    inside[labels[x]] = inside.get(labels[x], 0) + 1
                p += d
                totals[own] -= d
                pick, least = own, totals[own] * d - inside[own] * m2
                for c, k in inside.items():
                    cost = totals[c] * d - k * m2
                    if cost < least or cost == least and c < pick:
                        pick, least = c, cost
                totals[pick] += d
                if pick != own:
                    moved = True
                    labels[i] = label[i] = pick
                    total[own] -= d
                    total[pick] += d
        if not moved:
            break
    low = np.full(n, n)
    np.minimum.at(low, label, np.arange(n))
    return low[label]


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of all rows of a task; null is -1 in whole numbers."""
    t = pa.Table.from_batches(batches)
    return [(c.fill_null(-1) if pa.types.is_integer(c.type) else c).to_numpy() for c in t.columns]


def coded(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst) with names replaced by their numbers, given as (name, id); pairs with another name are left out."""
    at = lambda c, to: ids.select(F.col("name").alias(c), F.col("id").cast("int").alias(to))
    return pairs.join(at("dst", "b"), "dst").select("src", "b").join(at("src", "a"), "src").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _moved(links: DataFrame) -> DataFrame:
    """(id, community) of numbered links, each given once: the smallest number of each Louvain community.

    Every move depends on all before it, so one task takes them all, whatever their number; it holds 4 bytes a number
    of a link while it reads and about 50 bytes a link while it sorts, and nothing goes to the driver.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            a, b = _gathered(batches)
            names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            yield pa.RecordBatch.from_pydict({"id": names.astype(np.int64), "community": names[_louvain(ends[: len(a)], ends[len(a) :])].astype(np.int64)})

    return links.select("src", "dst").repartition(1).mapInArrow(move, "id long, community long")


def communities(adj: DataFrame, max_links: int | None = None) -> DataFrame:
    """(name, community): Louvain communities, named by their smallest member; gains count the links of the whole graph.

    Names move one by one in their order, however many there are; ``max_links`` has no effect any more.
    """
    pairs = cut(adj.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    ids = numbered(pairs.select(F.col("src").alias("name")).union(pairs.select("dst")).distinct(), "name", "id")
    found = _moved(coded(pairs, ids)).join(ids, "id")
    return found.join(ids.select(F.col("id").alias("community"), F.col("name").alias("low")), "community").select("name", F.col("low").alias("community"))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of a unique column, without sorting all rows in one task."""
    placed = cut(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()  # as many as partitions
    offsets, upto = [], 0
    for r in sizes:
        offsets.append((r["_part"], upto))
        upto += r["_n"]
    shifts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(shifts), "_part").withColumn(name, number).drop("_at", "_part", "_before")


def clusters(edges: DataFrame, symbols: DataFrame, files: DataFrame, min_size: int = 2, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, label, size, cohesion) and (cluster_id, name): the communities of the defined names.

    Synthesised edges take no part; if ``trusted`` is asked for, only EXTRACTED edges and INFERRED imports do, however many
    names there are. Names without a link are communities of their own; those of fewer than ``min_size`` names are left
    out, but keep their number, which follows the smallest name. A label is the folder of most members and the member with
    most links; cohesion is the share of links of the first fifty members that stay inside.
    """
    names = numbered(symbols.select("name").where("name IS NOT NULL").distinct(), "name", "id").select("id", "name")
    e = edges.where("synthesized_by IS NULL") if "synthesized_by" in edges.columns else edges
    if trusted:
        e = e.where("confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND kind = 'import')")
    known = coded(e.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst")).where("src <> dst"), names)
    links = cut(known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    found = cut(names.join(_moved(links), "id", "left").select("id", "name", F.coalesce("community", "id").alias("community")))
    ids = numbered(found.select("community").distinct(), "community", "cluster_id")
    members = found.join(ids, "community").select("cluster_id", "id", "name")
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    members = cut(members.join(sizes.select("cluster_id"), "cluster_id", "left_semi"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    both = links.select(F.col("src").cast("long").alias("id"), F.col("dst").cast("long").alias("far")).union(links.select("dst", "src"))
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = members.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    anchor = ranked.groupBy("cluster_id").agg(F.min(F.struct((-F.col("degree")).alias("d"), "name"))["name"].alias("anchor"))
    path = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("name").agg(F.min_by("path", "id").alias("path"))
    folders = members.join(path, "name").select("cluster_id", module_folder(F.col("path")).alias("folder")).where("folder IS NOT NULL")
    folder = folders.groupBy("cluster_id", "folder").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder"))["folder"].alias("folder"))
    sample = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).where("r <= 50").select("cluster_id", "id")
    ends = sample.join(both, "id").join(members.select(F.col("cluster_id").alias("there"), F.col("id").alias("far")), "far", "left")
    cohesion = ends.groupBy("cluster_id").agg((F.count(F.when(F.col("there") == F.col("cluster_id"), 1)) / F.count(F.lit(1))).alias("cohesion"))
    label = F.when(F.col("folder").isNotNull() & (F.col("folder") != F.col("anchor")), F.concat_ws(" — ", "folder", "anchor")).otherwise(F.col("anchor"))
    rows = sizes.join(anchor, "cluster_id").join(folder, "cluster_id", "left").join(cohesion, "cluster_id", "left")
    return rows.select("cluster_id", label.alias("label"), "size", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion")), members.select("cluster_id", "name")


def roots(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Defined names that call and are called by nobody else."""
    calls = adjacency(edges).where("kind = 'call'")
    return calls.select(F.col("src").alias("name")).distinct().join(symbols.select("name"), "name", "left_semi").join(calls.select(F.col("dst").alias("name")), "name", "left_anti")


def _best_reach(src: np.ndarray, dst: np.ndarray, root: np.ndarray, weight: np.ndarray, k: int, depth: int) -> list[tuple[float, int, int]]:
    """(minus score, number, reach) of the first ``k`` by weight times reach, then by number, of those of ``root`` that lead on
    and that nothing leads to.

    Paths of at most ``depth`` hops, counted apart by whether they end where nothing goes on, and no more than there are
    such ends, bound the reach. Names are walked from the highest bound on, until no bound comes up to the k-th score.
    """
    n = int(max((x.max() for x in (src, dst, root) if len(x)), default=-1)) + 1
    out, into = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    here = (out[root] > 0) & (into[root] == 0)
    root, weight = root[here], weight[here]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.concatenate([[0], np.cumsum(out)])
    end, ends = out[dst] == 0, int((out == 0).sum())
    going, ending = np.zeros(n), np.zeros(n)
    for _ in range(depth):
        going = np.minimum(np.bincount(src, np.where(end, 0, 1 + going[dst]), minlength=n), n - ends)
        ending = np.minimum(np.bincount(src, np.where(end, 1, ending[dst]), minlength=n), ends)
    bound = np.where(weight < 0, weight, weight * (going + ending)[root])  # all reach one name at least
    seen, place = np.full(n, -1), np.zeros(n, np.int64)

    def reach(i: int, turn: int) -> int:
        at, found = np.array([i]), 0
        seen[i] = turn
        for _ in range(depth):
            many = out[at]
            to = dst[np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            to = to[seen[to] != turn]
            seen[to], place[to] = turn, np.arange(len(to))
            at = to[place[to] == np.arange(len(to))]
            found += len(at)
        return found

    best: list[tuple[float, int, int]] = []
    for turn, j in enumerate(np.argsort(-bound, kind="stable").tolist()):
        if len(best) == k and bound[j] < -best[-1][0]:
            break
        r = reach(int(root[j]), turn)
        best = sorted([*best, (-float(weight[j]) * r, int(root[j]), r)])[:k]
    return best


def entry_points(edges: DataFrame, symbols: DataFrame, files: DataFrame, k: int = 20, depth: int = 5, calls_only: bool = False) -> DataFrame:
    """(name, kind, path, reach, score): the first ``k`` defined names outside of tests that refer and are not referred to, by
    entry score times reach, then by name. Names are placed by their first definition; a null score counts as 1.

    The numbered edges are walked in one task, which sends only the first ``k`` on.
    """
    e = edges.where("kind = 'call'") if calls_only else edges
    pairs = e.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst")).where("src <> dst")
    ids = numbered(pairs.select(F.col("src").alias("name")).union(pairs.select("dst")).distinct(), "name", "id")
    first = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("name").agg(F.min_by(F.struct("kind", "path", "entry_score"), "id").alias("d")).select("name", "d.*")
    weight = F.coalesce(F.when(F.isnan("entry_score"), None).otherwise(F.col("entry_score")), F.lit(1.0))
    defined = cut(first.where(~is_test_path(F.col("path"))).join(ids, "name").select(F.col("id").cast("int"), "name", "kind", "path", weight.cast("double").alias("weight")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        a, b, w = _gathered(batches)
        link = b >= 0
        best = _best_reach(a[link], b[link], a[~link], w[~link], k, depth)
        yield pa.RecordBatch.from_pydict({"id": pa.array([i for _, i, _ in best], pa.int32()), "reach": pa.array([r for *_, r in best], pa.int64()), "score": pa.array([-s for s, *_ in best], pa.float64())})

    rows = coded(pairs, ids).distinct().select("src", "dst", F.lit(None).cast("double").alias("weight")).union(defined.select("id", F.lit(None).cast("int"), "weight"))
    far = cut(rows.repartition(1).mapInArrow(rank, "id int, reach long, score double"))
    return defined.join(F.broadcast(far), "id").select("name", "kind", "path", "reach", "score").orderBy(F.desc("score"), "name").limit(k)


def flow_tree(edges: DataFrame, symbols: DataFrame, entry: str, depth: int = 6, breadth: int = 8) -> DataFrame:
    """(name, parent, depth, place, kind, truncated): what an entry sets off, every name once, at most ``breadth`` a parent.

    Callees are taken by (name, kind); a parent claims all its own before it descends into the first, so that of two
    parents the one visited first in depth has a callee. The tree is drawn again and again, as far as callees are known;
    before each time those that the last one lacked are fetched, ``breadth`` and one more of a name at first, then twice as
    many as are known. It ends when nothing was lacking, so the driver holds callees of names that stood in a tree only.
    """
    adj = cut(adjacency(edges).groupBy("src", "dst").agg(F.min("kind").alias("kind")))
    spark = edges.sparkSession
    near: dict[str, list[tuple[str, str]]] = {}
    whole: set[str] = set()  # names of which all callees are known
    same: dict[str, str] = {}

    def draw() -> tuple[list[tuple[str, str, int, int, str]], set[str], set[str]]:
        claimed, out, cut_short, lacking = {entry}, [], set(), set()

        def visit(name: str, level: int) -> None:
            mine = []
            for t, k in near.get(name, ()):
                if t not in claimed:
                    mine.append((t, k))
                    if len(mine) > breadth:
                        break
            if len(mine) <= (breadth if level < depth else 0) and name not in whole:
                lacking.add(name)
            if not mine:
                return
            if level + 1 > depth:
                cut_short.add(name)
                return
            if len(mine) > breadth:
                cut_short.add(name)
            mine = mine[:breadth]
            claimed.update(t for t, _ in mine)
            for place, (t, k) in enumerate(mine, 1):
                out.append((t, name, level + 1, place, k))
                visit(t, level + 1)

        visit(entry, 0)
        return out, cut_short, lacking

    while True:
        out, cut_short, lacking = draw()
        if not lacking:
            break
        todo = spark.createDataFrame([(x, len(near.get(x, ())), max(breadth + 1, 2 * len(near.get(x, ())))) for x in sorted(lacking)], "src string, have int, want int")
        todo, _ = sized(todo)
        order = Window.partitionBy("src").orderBy("dst")
        rows = adj.join(todo, "src").withColumn("r", F.row_number().over(order)).where("r > have AND r <= want").select("src", "dst", "kind", "r", "want").orderBy("src", "r")
        full = dict.fromkeys(lacking, False)
        for x in lacking:
            near.setdefault(x, [])
        for r in rows.toLocalIterator():
            near[r["src"]].append((same.setdefault(r["dst"], r["dst"]), same.setdefault(r["kind"], r["kind"])))
            full[r["src"]] = r["r"] == r["want"]
        whole.update(x for x in lacking if not full[x])
    rows = [(*r, r[0] in cut_short) for r in out]
    return spark.createDataFrame(rows, "name string, parent string, depth int, place int, kind string, truncated boolean")


def neighbourhood(edges: DataFrame, name: str, direction: str = "both") -> DataFrame:
    """(src, dst, kind, confidence): the distinct edges of one name, literally."""
    e = edges.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"), "kind", "confidence").where("src <> dst")
    into, out = F.col("dst") == name, F.col("src") == name
    return e.where({"incoming": into, "outgoing": out}.get(direction, into | out)).distinct()


def constellation(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, representative, members) and (from_cluster, to_cluster, weight): clusters and the links between them.

    A name belongs to the cluster of its first definition; the representative is a cluster's definition with the smallest
    id."""
    first = symbols.groupBy("name").agg(F.min_by("cluster_id", "id").alias("c")).where("c IS NOT NULL")
    nodes = symbols.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min_by("name", "id").alias("representative"), F.countDistinct("name").alias("members"))
    e = adjacency(edges).select("src", "dst").distinct()
    ends = e.join(first.select(F.col("name").alias("src"), F.col("c").alias("from_cluster")), "src").join(first.select(F.col("name").alias("dst"), F.col("c").alias("to_cluster")), "dst")
    return nodes, ends.where("from_cluster <> to_cluster").groupBy("from_cluster", "to_cluster").agg(F.count(F.lit(1)).alias("weight"))
