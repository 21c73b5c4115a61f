"""The k most similar vectors of every vector, by collision counting on single projections.

1. Vectors of one direction, whatever their lengths, can only be told apart by id, so only the k+1 smallest ids of each
   such class (its heads) take part as candidates; every further member is answered by the first k heads of its own
   class. Directions are compared as 16-bit integers, by a 128-bit hash of all of them.
2. Heads are routed: each goes to the cells whose pivot it projects on most, ``routes`` of them and more the more pivots
   there are (``routes_among``), so that recall does not fall with size. Pivots are a bounded sample of the vectors, all
   heads are indexed. A cell of more than ``max_cell`` heads is routed again by what is left of its vectors beside their
   mean, among pivots drawn from its own heads, and again if need be; what is still too large after ``depth`` rounds is
   compared block by block, each two of its blocks in a task of their own.
3. In a cell, every vector is projected on ``projections`` random lines and each line's values are sorted. A query
   centres a window on its own value in each sorted array; the window is widened by virtual rehashing from one radius
   to the next until the query has k neighbours inside the radius or the last radius, that of ``min_similarity``, is
   done. Vectors that share at least ``collisions`` windows with it are verified by their cosine. A window holds up to
   half of a cell, so collisions are counted for all of a cell at once, by comparing places in the sorted arrays.
4. A vector's candidates from its cells are merged, best first, ties by smaller id.

Shuffled are the heads once for each cell they are routed to, as 16-bit integers scaled to the largest component (which
moves a cosine by less than 0.00001), and beside that only ids and hashes, unless very many classes have more than k
members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.registry import shared_dir

MAX_PIVOT_BYTES = 128 << 20  # of all pivots of one round together, which the driver sends to the executors
WIDEN = 0.75  # the similarity of the last radius where none is asked for
WIDTH = 1.5  # half a window, in radii: a pair at the radius shares 87 % of the windows


def usable(df: DataFrame, id_col: str, group_col: str, vector_col: str, dim_col: str | None) -> DataFrame:
    """Rows (id, grp, dim, vec) whose vector can be compared: neither null nor all zeros, finite, as long as its
    ``dim``, with an id and a group. Others are left out and take no part."""
    v = F.col(f"`{vector_col}`").cast("array<float>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{group_col}`").alias("grp"), v.alias("vec"), *([F.col(f"`{dim_col}`").cast("int").alias("dim")] if dim_col else [F.size(v).alias("dim")]))
    fits = F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & (F.col("dim") > 0)
    inf = F.lit(float("inf"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return rows.where(fits).where(~bad & F.exists("vec", lambda x: x != 0.0))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _codes(unit: np.ndarray) -> pa.Array:
    q = np.rint(unit * (32767 / np.abs(unit).max(axis=1, keepdims=True))).astype("<i2")
    offsets = np.arange(len(q) + 1, dtype=np.int32) * (2 * q.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(q))])


def _decoded(codes: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), "<i2").reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(p: np.ndarray, r: int) -> np.ndarray:
    return np.argpartition(-p, r - 1, axis=1)[:, :r] if r < p.shape[1] else np.tile(np.arange(p.shape[1]), (len(p), 1))


def routes_among(pivots: int, routes: int) -> int:
    """How many of so many pivots a vector goes to: one more than ``routes`` from 128 on, and for each fourfold of that."""
    return routes + max(0, (max(pivots, 1) // 32).bit_length() - 1) // 2


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function on usable rows: the direction as integers, and two hashes of them."""
    import xxhash

    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
            code = _codes(_unit(rows.column("vec"), dim))
            both = np.array([np.frombuffer(xxhash.xxh3_128_digest(x), np.int64) for x in code.to_pylist()])
            out = [rows.column("grp").cast(pa.string()), pa.array(np.full(len(rows), dim, np.int32)), rows.column("id"), code, pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays(out, names=["grp", "dim", "id", "code", "c1", "c2"])


CELLS = "grp string, dim int, cell string, id long, code binary"


def router(pivots: dict[tuple[str, int], np.ndarray], routes: int):
    """A mapInArrow function on (grp, dim, id, code): each row once for each cell it is routed to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            names = np.asarray(batch.column("grp").to_pylist(), dtype=object)
            for key in {*zip(names.tolist(), dims.tolist(), strict=True)}:
                rows = batch.take(pa.array(np.flatnonzero((names == key[0]) & (dims == key[1]))))
                x = _decoded(rows.column("code").to_pylist(), key[1])
                cells = _top(x @ pivots[key].T, routes_among(len(pivots[key]), routes))
                at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                out = [pa.array([key[0]] * len(at)), pa.array(np.full(len(at), key[1], np.int32)), pa.array(cells.ravel()).cast(pa.string()), rows.column("id").take(at), rows.column("code").take(at)]
                yield pa.RecordBatch.from_arrays(out, names=["grp", "dim", "cell", "id", "code"])

    return route


def again(pivots: dict[tuple[str, int, str], np.ndarray], routes: int):
    """A mapInArrow function on rows of cells: those of crowded cells once for each smaller cell they are routed to."""
    centred = {}
    for key, p in pivots.items():
        mean = p.mean(axis=0)
        lines = p - mean
        centred[key] = mean, lines / np.maximum(np.linalg.norm(lines, axis=1, keepdims=True), 1e-6)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "dim", "cell")), strict=True))
            places: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):
                places.setdefault(key, []).append(k)
            for key, mine in places.items():
                rows = batch.take(pa.array(mine))
                mean, lines = centred[key]
                cells = _top((_decoded(rows.column("code").to_pylist(), key[1]) - mean) @ lines.T, routes_among(len(lines), routes))
                at = pa.array(np.repeat(np.arange(len(mine)), cells.shape[1]))
                names = pa.array([f"{key[2]}.{c}" for c in cells.ravel().tolist()])
                out = [pa.array([key[0]] * len(at)), pa.array(np.full(len(at), key[1], np.int32)), names, rows.column("id").take(at), rows.column("code").take(at)]
                yield pa.RecordBatch.from_arrays(out, names=["grp", "dim", "cell", "id", "code"])

    return route


def _in_blocks(dense: DataFrame, max_cell: int) -> DataFrame:
    """Rows of cells (with ``n``, the rows in the cell) that no pivot could divide: once for each other block of the cell, so
    that every two rows meet in a task of at most about ``max_cell`` rows."""
    blocks = F.greatest(F.lit(2), F.ceil(2 * F.col("n") / max_cell)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    placed = dense.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", "cell", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    # a block meets itself wherever it meets another
    return placed.where("own <> other").select("grp", "dim", name.alias("cell"), "id", "code")


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the neighbour, similarity), exact: up to k neighbours a query, ties by smaller id."""
    s = np.round(queries.astype(np.float64) @ x.astype(np.float64).T, 7)
    s[query_ids[:, None] == ids[None, :]] = -2
    least = np.partition(s, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
    q, o = np.nonzero((s >= least[:, None]) & (s > -2))
    by = np.lexsort((ids[o], -s[q, o], q))
    q, o = q[by], o[by]
    top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[top], o[top], s[q[top], o[top]]


def collide(ids: np.ndarray, x: np.ndarray, k: int, min_similarity: float | None, projections: int, collisions: int, seed: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one cell: (query ids, neighbour ids, similarities), up to k neighbours a query.

    Without a ``min_similarity`` a query that has fewer than k within the last radius is compared with the whole cell.
    """
    n = len(ids)
    widen, min_similarity = min_similarity is None, WIDEN if min_similarity is None else min_similarity
    lines = np.random.default_rng(seed).standard_normal((x.shape[1], projections)).astype(np.float32)
    p = x @ lines
    order = np.argsort(p, axis=0, kind="stable")
    arrays = np.take_along_axis(p, order, axis=0)
    kind = np.uint16 if n < 65_000 else np.uint32
    place = np.empty((projections, n), kind)
    for i in range(projections):
        place[i, order[:, i]] = np.arange(n, dtype=kind)
    last = float(np.sqrt(max(0.0, 2 - 2 * min_similarity)))
    radii = [last * 0.62, last]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, n, block):
        open_ = np.arange(start, min(n, start + block))
        for radius in radii:
            counts = np.zeros((len(open_), n), np.uint8)
            for i in range(projections):
                own = p[open_, i]
                lo = np.searchsorted(arrays[:, i], own - WIDTH * radius, "left")
                hi = np.searchsorted(arrays[:, i], own + WIDTH * radius, "right")
                # a place below lo wraps round to a large number
                counts += (place[i][None, :] - lo.astype(kind)[:, None]) < (hi - lo).astype(kind)[:, None]
            q, o = np.nonzero(counts >= collisions)
            keep = ids[open_[q]] != ids[o]
            q, o = q[keep], o[keep]
            s = np.empty(len(q))
            for j in range(0, len(q), 65_536):
                s[j : j + 65_536] = np.einsum("ij,ij->i", x[open_[q[j : j + 65_536]]], x[o[j : j + 65_536]], dtype=np.float64)
            s = np.round(s, 7)
            floor = 1 - radius * radius / 2
            near = s >= max(floor, min_similarity) - 1e-7
            done = np.bincount(q[near], minlength=len(open_)) >= k
            if radius == last and not widen:
                done[:] = True
            take = done[q] & (s >= min_similarity - 1e-7)
            q, o, s = q[take], o[take], s[take]
            by = np.lexsort((ids[o], -s, q))
            q, o, s = q[by], o[by], s[by]
            first = np.searchsorted(q, q, "left")
            top = np.arange(len(q)) - first < k
            found.append((ids[open_[q[top]]], ids[o[top]], s[top]))
            open_ = open_[~done]
            if not len(open_):
                break
        if len(open_):
            at, o, s = nearest(ids[open_], x[open_], ids, x, k)
            found.append((ids[open_[at]], ids[o], s))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def similar_vectors(
    df: DataFrame, id_col: str, group_col: str, vector_col: str, dim_col: str | None = None, k: int = 5, min_similarity: float | None = 0.75,
    routes: int = 3, per_pivot: int = 256, max_pivots: int = 8192, max_cell: int = 16_384, projections: int = 32, collisions: int = 24, seed: int = 7, depth: int = 4,
) -> DataFrame:
    """Rows (grp, id, neighbour, similarity): for each usable vector its k most similar ones of the same group with a
    cosine of at least ``min_similarity``, ties by smaller id; found with a recall below 1, see the README. Without a
    ``min_similarity`` each has k of them if its group has as many others; those that have too few in their cells are
    compared with all heads of the group.

    Unusable rows (see ``usable``) take no part; rows repeated under one id count once; no row is its own neighbour; an
    empty table gives no rows. Vectors of one group but of different sizes are not compared.
    """
    rows = usable(df, id_col, group_col, vector_col, dim_col)
    spark = df.sparkSession
    shared_dir(spark)
    copies = Window.partitionBy("grp", "dim", "c1", "c2").orderBy("id")
    # everything below reads these rows, of half the size of the vectors; without the cut each would scan and scale them again
    keyed = rows.mapInArrow(encode, "grp string, dim int, id long, code binary, c1 long, c2 long").checkpoint()
    first = keyed.select("grp", "dim", "c1", "c2", "id").distinct().withColumn("rn", F.row_number().over(copies)).where(F.col("rn") <= k + 1)
    full = first.groupBy("grp", "dim", "c1", "c2").agg(F.array_sort(F.collect_set("id")).alias("h")).where(F.size("h") > k).checkpoint()
    lasts = full.select("grp", "dim", "c1", "c2", F.element_at("h", -1).alias("last"))
    heads = keyed.join(F.broadcast(lasts) if full.count() <= 100_000 else lasts, ["grp", "dim", "c1", "c2"], "left").where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("grp", "dim", "id", "code")

    sizes = {(r["grp"], r["dim"]): r["n"] for r in heads.groupBy("grp", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a model
    schema = "grp string, id long, neighbour long, similarity double"
    if not sizes:
        return spark.createDataFrame([], schema)
    wanted = {g: min(max_pivots, max(routes, n // per_pivot)) for g, n in sizes.items()}
    over = max(1.0, sum(4 * g[1] * w for g, w in wanted.items()) / MAX_PIVOT_BYTES)
    wanted = {g: max(1, int(w / over)) for g, w in wanted.items()}
    shares = spark.createDataFrame([(g, d, 1.5 * wanted[g, d] / n) for (g, d), n in sizes.items()], "grp string, dim int, share double")
    lot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn: dict[tuple[str, int], dict[bytes, np.ndarray]] = {}  # a direction counts once
    for r in heads.join(F.broadcast(shares), ["grp", "dim"]).where(lot < F.col("share")).select("grp", "dim", "id", "code", lot.alias("lot")).orderBy("lot").toLocalIterator():
        mine = drawn.setdefault((r["grp"], r["dim"]), {})
        if len(mine) < wanted[r["grp"], r["dim"]]:
            mine[bytes(r["code"])] = _decoded([bytes(r["code"])], r["dim"])[0]
    pivots = {g: np.stack(list(drawn[g].values())) if drawn.get(g) else np.eye(1, g[1], dtype=np.float32) for g in sizes}

    open_, cells = heads.mapInArrow(router(pivots, routes), CELLS), None
    for level in range(depth + 1):
        # at most (rows * routes / max_cell) of them
        crowds = {(r["grp"], r["dim"], r["cell"]): r["n"] for r in open_.groupBy("grp", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_cell).collect()}
        if not crowds:
            cells = open_ if cells is None else cells.unionByName(open_)
            break
        want = {c: min(max_pivots, max(2, -(-n // per_pivot))) for c, n in crowds.items()}
        over = max(1.0, sum(4 * c[1] * w for c, w in want.items()) / MAX_PIVOT_BYTES)
        listed = spark.createDataFrame([(*c, n, max(2, want[c] / over) / n) for c, n in crowds.items()], "grp string, dim int, cell string, n long, share double")
        calm = open_.join(F.broadcast(listed), ["grp", "dim", "cell"], "left_anti")
        cells = calm if cells is None else cells.unionByName(calm)
        dense = open_.join(F.broadcast(listed), ["grp", "dim", "cell"])
        if level == depth:
            cells = cells.unionByName(_in_blocks(dense, max_cell))
            break
        own_lot = F.pmod(F.xxhash64("id", "cell", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
        sample: dict[tuple[str, int, str], list[bytes]] = {c: [] for c in crowds}
        for r in dense.where(own_lot < F.col("share")).select("grp", "dim", "cell", "code").toLocalIterator():
            sample[r["grp"], r["dim"], r["cell"]].append(bytes(r["code"]))
        lines = {c: _decoded(v, c[1]) if v else np.eye(1, c[1], dtype=np.float32) for c, v in sample.items()}
        open_ = dense.select("grp", "dim", "cell", "id", "code").mapInArrow(again(lines, routes), CELLS)

    def search(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t.column("id").to_numpy(), return_index=True)
        x = _decoded(t.column("code").take(pa.array(at)).to_pylist(), t.column("dim")[0].as_py())
        a, b, s = collide(ids, x, k, min_similarity, projections, collisions, seed)
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(a), pa.string()), "id": a, "neighbour": b, "similarity": s})

    near = cells.groupBy("grp", "dim", "cell").applyInArrow(search, schema)
    best = _merged(near, k)
    if min_similarity is None:
        best = best.checkpoint()
        best = best.where(F.size("b") == k).unionByName(_short(heads, best, k))
    own = best.select("grp", "id", F.explode("b").alias("b")).select("grp", "id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.s")).alias("similarity"))
    rest = keyed.select("grp", "dim", "c1", "c2", "id").join(full, ["grp", "dim", "c1", "c2"]).where(F.col("id") > F.element_at("h", -1)).distinct()
    tails = rest.select("grp", "id", F.explode(F.slice("h", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))
    return own.unionByName(tails)


def _short(heads: DataFrame, best: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``best`` of those heads that have fewer than k there, against all heads; such are rare, being in small cells only."""
    spark = heads.sparkSession
    out = spark.createDataFrame([], best.schema)
    schema = "grp string, id long, neighbour long, similarity double"

    def against(queries: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                names = np.asarray(batch.column("grp").to_pylist(), dtype=object)
                for key, (ids, x) in queries.items():
                    rows = batch.take(pa.array(np.flatnonzero((names == key[0]) & (dims == key[1]))))
                    if not len(rows):
                        continue
                    others, at = np.unique(rows.column("id").to_numpy(), return_index=True)
                    q, o, s = nearest(ids, x, others, _decoded(rows.column("code").take(pa.array(at)).to_pylist(), key[1]), k)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(q), pa.string()), pa.array(ids[q]), pa.array(others[o]), pa.array(s)], names=["grp", "id", "neighbour", "similarity"])

        return run

    def flush(held: list) -> DataFrame:
        queries = {}
        for key in {(r["grp"], r["dim"]) for r in held}:
            mine = [r for r in held if (r["grp"], r["dim"]) == key]
            queries[key] = np.array([r["id"] for r in mine], np.int64), _decoded([bytes(r["code"]) for r in mine], key[1])
        return _merged(heads.mapInArrow(against(queries), schema), k)

    held = []
    for r in heads.join(best.where(F.size("b") == k).select("grp", "id"), ["grp", "id"], "left_anti").dropDuplicates(["grp", "dim", "id"]).toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = out.unionByName(flush(held)), []
    return out.unionByName(flush(held)) if held else out


def _merged(near: DataFrame, k: int) -> DataFrame:
    return near.groupBy("grp", "id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k).alias("b"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of which one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
