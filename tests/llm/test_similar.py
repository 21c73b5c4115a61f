import numpy as np

from graphloom.llm.similar import collide, routes_among, similar_pairs, similar_vectors

SCHEMA = "symbol_id long, model string, dim int, vector array<float>, id string"  # ``id`` clashes with a name used inside


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for a in range(len(x)):
        s = x @ x[a]
        s[a] = -2
        for b in np.lexsort((ids, -np.round(s, 7)))[:k]:
            if s[b] >= least and a != b:
                out.add((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
    return out


def clusters(rng, n, per, dim):
    c = rng.standard_normal((n, dim))
    return np.concatenate([c[i] + 0.35 * rng.standard_normal((per, dim)) for i in range(n)]).astype(np.float32)


def test_collisions_find_the_neighbours():
    rng = np.random.default_rng(5)
    x = clusters(rng, 40, 8, 64)
    ids = np.arange(len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b, _ = collide(ids, unit, 5, 0.75, 32, 24, 1)
    got = {(int(min(p, q)), int(max(p, q))) for p, q in zip(a, b, strict=True)}
    want = brute(ids, x, 5, 0.75)
    assert len(got & want) / len(want) >= 0.95


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = clusters(rng, 150, 10, 48) * rng.uniform(0.2, 4, (1500, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", per_pivot=32)).collect()}
    want = brute(np.arange(len(x)), x, 5, 0.75)
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_crowded_cells_are_split_and_stay_found(spark):
    rng = np.random.default_rng(7)
    x = clusters(rng, 120, 6, 48)
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", per_pivot=100, max_cell=150)).collect()}
    want = brute(np.arange(len(x)), x, 5, 0.75)
    assert len(got & want) / len(want) >= 0.9


def test_unusable_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m", 2, [1.0, 0.0]), (2, "m", 2, [2.0, 0.0]), (3, "m", 2, [nan, 1.0]), (4, "m", 2, None), (5, "m", 2, [0.0, 0.0]), (6, "m", 2, [1.0]), (7, "m", 2, [inf, 0.0]), (8, "n", 2, [1.0, 0.0]), (9, None, 2, [1.0, 0.0]), (10, "m", None, [1.0, 0.0]), (None, "m", 2, [1.0, 0.0]), (11, "m", 2, [0.0, 1.0]), (12, "m", 3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim")).collect()}
    assert got == {(1, 2)}
    assert similar_vectors(df.limit(0), "symbol_id", "model", "vector", "dim").isEmpty()


def test_many_copies_are_linked_to_their_first(spark):
    rows = [(i, "m", 3, [1.0, 2.0, 3.0], "x") for i in range(30)] + [(100, "m", 3, [1.0, 2.0, 3.01], "x"), (100, "m", 3, [1.0, 2.0, 3.01], "x")]
    got = {tuple(r) for r in similar_pairs(similar_vectors(spark.createDataFrame(rows, SCHEMA), "symbol_id", "model", "vector", "dim", k=3)).collect()}
    assert {(0, 29), (1, 29), (2, 29), (0, 1), (0, 3), (0, 100), (1, 100), (2, 100)} <= got
    assert (3, 29) not in got and len(got) == 3 + 27 * 3 + 3


def test_routes_keep_recall_as_pivots_grow(spark):
    assert [routes_among(n, 3) for n in (1, 26, 127, 128, 511, 512, 2600, 8192)] == [3, 3, 3, 4, 4, 5, 6, 7]
    rng = np.random.default_rng(8)
    x = clusters(rng, 500, 8, 48)
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", per_pivot=4, projections=1, collisions=0)).collect()}
    want = brute(np.arange(len(x)), x, 5, 0.75)
    assert len(got & want) / len(want) >= 0.97


def test_copies_do_not_crowd_a_cell(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([clusters(rng, 60, 8, 48), np.tile(clusters(rng, 1, 1, 48), (1200, 1))])
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", routes=1, per_pivot=8, max_pivots=1, max_cell=600, projections=1, collisions=0)).collect()}
    assert {p for p in got if max(p) < 480} == brute(np.arange(480), x[:480], 5, 0.75)


def test_real_crowds_are_split_by_their_own_vectors(spark):
    rng = np.random.default_rng(10)
    x = clusters(rng, 200, 8, 48)
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", per_pivot=10, max_pivots=160, routes=3, max_cell=20, projections=1, collisions=0)).collect()}
    want = brute(np.arange(len(x)), x, 5, 0.75)
    assert len(got & want) / len(want) >= 0.9


def test_without_a_least_similarity_every_vector_has_k_neighbours(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([clusters(rng, 60, 2, 24), rng.standard_normal((80, 24)), np.tile([[1.0] * 24], (12, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, "m", 24, v.tolist(), "x") for i, v in enumerate(x)] + [(900, "n", 2, [1.0, 0.0], "x"), (901, "n", 2, [0.0, 1.0], "x")], SCHEMA)
    for options in ({}, {"routes": 1, "per_pivot": 4}):  # one cell; small cells, many of fewer than k others
        rows = similar_vectors(df, "symbol_id", "model", "vector", "dim", min_similarity=None, **options).collect()
        got = {}
        for r in rows:
            got.setdefault(r["id"], []).append((-r["similarity"], r["neighbour"]))
        assert all(len(got[i]) == 5 for i in range(len(x))) and len(got[900]) == len(got[901]) == 1
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    one = {}
    for r in similar_vectors(df, "symbol_id", "model", "vector", "dim", min_similarity=None).collect():
        one.setdefault(r["id"], []).append(r["similarity"])
    for i in range(120):
        s = np.sort(np.delete(unit @ unit[i], i))[::-1][:5]
        assert np.allclose(sorted(one[i], reverse=True), s, atol=1e-5) or one[i][0] >= 0.75


def test_scaled_copies_are_one_class(spark):
    rng = np.random.default_rng(12)
    x = clusters(rng, 40, 8, 48)
    copies = np.tile(x[:1], (50_000, 1)) * rng.uniform(0.1, 9, (50_000, 1)).astype(np.float32)
    every = np.concatenate([x, copies])
    df = spark.createDataFrame([(i, "m", 48, v, "x") for i, v in enumerate(every.tolist())], SCHEMA)
    got = similar_vectors(df, "symbol_id", "model", "vector", "dim")
    per = {r["id"]: r["n"] for r in got.groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert all(per[i] == 5 for i in range(320, len(every)))
    near = {}
    for r in got.where("id < 320").collect():
        near.setdefault(r["id"], set()).add(r["neighbour"])
    assert near[0] == {320, 321, 322, 323, 324}
    far = [i for i in range(8, 320)]
    want = brute(np.arange(320), x, 5, 0.75)
    assert len({(min(a, b), max(a, b)) for a in far for b in near.get(a, ())} & want) >= 0.95 * len({p for p in want if p[0] >= 8})


def test_what_pivots_cannot_divide_is_compared_in_blocks(spark):
    rng = np.random.default_rng(13)
    x = clusters(rng, 60, 8, 48)
    df = spark.createDataFrame([(i, "m", 48, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_vectors(df, "symbol_id", "model", "vector", "dim", routes=1, max_pivots=1, max_cell=40, depth=0, projections=1, collisions=0)).collect()}
    assert got == brute(np.arange(len(x)), x, 5, 0.75)
