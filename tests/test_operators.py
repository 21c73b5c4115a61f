"""Small graphs and awkward rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R
from graphloom.operators import skew, sync
from graphloom.sources import ingest


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k) for a, b, k in pairs], "source_name string, target_name string, kind string")


def symbols(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")


def walked(spark, pairs, defined, seed, depth=3, direction="upstream"):
    hops = G.resolved(G.adjacency(edges(spark, [(a, b, "call") for a, b in pairs])), symbols(spark, defined))
    seeds = spark.createDataFrame([(seed,)], "name string")
    return {r["name"]: (r["distance"], r["rank"]) for r in G.walk(hops, seeds, direction, depth).collect()}


def test_chain_and_depth(spark):
    chain = [("C", "B"), ("B", "A")]
    assert walked(spark, chain, "ABC", "A") == {"B": (1, 2), "C": (2, 2)}
    assert walked(spark, chain, "ABC", "A", depth=1) == {"B": (1, 2)}
    assert walked(spark, chain, "ABC", "C", direction="downstream") == {"B": (1, 2), "A": (2, 2)}


def test_cycle_ends_and_seed_stays_out(spark):
    assert walked(spark, [("A", "B"), ("B", "A")], "AB", "A") == {"B": (1, 2)}


def test_diamond_takes_strongest_of_weakest(spark):
    pairs = [("D", "B"), ("D", "C"), ("B", "A"), ("C", "A")]
    assert walked(spark, pairs, ["A", "B", "B", "C", "D"], "A")["D"] == (2, 2)


def test_self_edge_homonym_unresolved(spark):
    got = walked(spark, [("A", "A"), ("X", "A"), ("Y", "X"), ("Z", "Q")], ["A", "X", "X"], "A")
    assert got == {"X": (1, 2), "Y": (2, 0)}
    assert walked(spark, [("Z", "Q")], ["A"], "Q") == {"Z": (1, 1)}


def test_empty_graph(spark):
    assert walked(spark, [], ["A"], "A") == {}


def test_trace(spark):
    adj = G.adjacency(edges(spark, [("a", "b", "call"), ("a", "c", "call"), ("b", "d", "call"), ("c", "d", "call")]))
    rows = [(r["hop"], r["src"], r["dst"]) for r in G.trace(adj, "a", "d").orderBy("hop").collect()]
    assert rows == [(1, "a", "b"), (2, "b", "d")]
    assert G.trace(adj, "a", "a").isEmpty() and G.trace(adj, "d", "a").isEmpty()


def test_components_and_communities(spark):
    k4 = lambda p: [(f"{p}{i}", f"{p}{j}", "call") for i in range(4) for j in range(i)]
    adj = G.adjacency(edges(spark, k4("a") + k4("b") + [("a0", "b0", "call"), ("z", "y", "call")]))
    comp = {r["name"]: r["component"] for r in G.components(adj.select("src", "dst")).collect()}
    assert comp["b3"] == "a0" and comp["z"] == "y" and len(comp) == 10
    com = {r["name"]: r["community"] for r in G.communities(adj).collect()}
    assert len({com[f"a{i}"] for i in range(4)}) == 1 and com["a1"] != com["b1"]


def test_large_components_move_by_modularity(spark):
    # six cliques of five in a ring and a hub that touches them all
    k5 = [(f"{c}{i}", f"{c}{j}", "call") for c in "abcdef" for i in range(5) for j in range(i)]
    ring = [(f"{c}0", f"{d}1", "call") for c, d in zip("abcdef", "bcdefa", strict=True)] + [("hub", f"{c}2", "call") for c in "abcdef"]
    adj = G.adjacency(edges(spark, k5 + ring))
    com = {r["name"]: r["community"] for r in G.communities(adj, max_links=0).collect()}
    assert len({com[f"{c}0"] for c in "abcdef"}) == 6 and all(com[f"{c}{i}"] == com[f"{c}0"] for c in "abcdef" for i in range(5))
    assert len(com) == 31
    pairs = [(x, y) for x, y, _ in k5 + ring]
    degree = {n: sum(n in p for p in pairs) for n in com}
    gain = lambda n, c: sum(com[y if x == n else x] == c for x, y in pairs if n in (x, y)) - degree[n] * sum(degree[o] for o in com if o != n and com[o] == c) / (2 * len(pairs))
    assert all(gain(n, com[n]) >= gain(n, c) - 1e-9 for n in com for c in {*com.values()})


def test_a_pair_of_a_large_component_does_not_swap_labels(spark):
    adj = G.adjacency(edges(spark, [("p", "q", "call")]))
    assert {r["community"] for r in G.communities(adj, max_links=0).collect()} == {"p"}


def test_long_path_is_one_component(spark):
    adj = G.adjacency(edges(spark, [(f"n{i:03}", f"n{i + 1:03}", "call") for i in range(60)]))
    assert {r["component"] for r in G.components(adj.select("src", "dst")).collect()} == {"n000"}


def test_pagerank_star(spark):
    adj = G.adjacency(edges(spark, [("hub", f"leaf{i}", "call") for i in range(5)]))
    got = {r["name"]: r["score"] for r in G.pagerank(adj, spark.createDataFrame([("hub",)], "name string")).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["hub"] > got["leaf0"]


def test_registered_pagerank_runs_to_its_tolerance(spark, tmp_path):
    import numpy as np

    from graphloom.plans import graph as queries

    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "b"), ("e", "b")]
    spark.createDataFrame([(x, y, "call") for x, y in links], "source_name string, target_name string, kind string").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(x,) for x in "abcde"], "name string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = {r["name"]: r["score"] for r in queries.pagerank(spark, str(tmp_path)).collect()}
    m, start = np.zeros((5, 5)), np.eye(5)[1]  # b is referenced most; edges count both ways, once a pair
    pairs = {(x, y) for x, y in links} | {(y, x) for x, y in links}
    for x, y in pairs:
        m["abcde".index(y), "abcde".index(x)] = 1 / sum(x == a for a, _ in pairs)
    want = start
    for _ in range(30):
        want = 0.85 * m @ want + 0.15 * start
    assert all(abs(got[n] - want["abcde".index(n)]) < 1e-6 for n in "abcde")


def test_key_profile_awkward_rows(spark):
    rows = [("a", "x", 1, 0), ("a", "x", 1, 0), ("a", None, 2, 0), (None, "y", None, 0), ("", "y", 3, 0), ("b", None, None, 0)]
    df = spark.createDataFrame(rows, "k string, v string, n int, `value` int")  # ``value`` clashes with a name used inside
    got = {r["key"]: r.asDict() for r in skew.key_profile(df, "k", distinct=["v", "value"], modes=["v"]).collect()}
    assert got["a"]["n_rows"] == 3 and got["a"]["distinct_v"] == 1 and got["a"]["mode_v"] == "x"
    assert got[None]["n_rows"] == 1 and got["b"]["mode_v"] is None and got[""]["distinct_value"] == 1
    assert skew.key_profile(df.limit(0), "k", distinct=["v"]).isEmpty()


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("k", v) for v in ("b", "a", "b", "a", "c")], "k string, v string")
    assert skew.key_profile(df, "k", modes=["v"]).first()["mode_v"] == "a"


def test_percentiles_match_sorting(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [("hot", rng.randint(-50, 5000)) for _ in range(2000)] + [("one", 7), ("none", None), (None, 4), (None, 9)]
    got = {r["key"]: (r["p50"], r["p90"]) for r in skew.key_percentiles(spark.createDataFrame(rows, "k string, v int"), "k", "v", [0.5, 0.9]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got["hot"] == tuple(hot[max(1, math.ceil(f * len(hot))) - 1] for f in (0.5, 0.9))
    assert got["one"] == (7, 7) and got[None] == (4, 9) and "none" not in got


def test_fuzzy_is_damerau(spark):
    names = spark.createDataFrame([(x,) for x in ("abcd", "abdc", "abce", "xabcd", "abc", "zzz", "", None, "abcd")], "name string")
    got = {(r["name"], r["distance"]) for r in R.fuzzy(names, spark.createDataFrame([("abcd",)], "query string")).collect()}
    assert got == {("abcd", 0), ("abdc", 1), ("abce", 1), ("xabcd", 1), ("abc", 1)}


def test_cosine_skips_unusable(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.1]), (6, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    q = v.where("id = 1").select(F.col("id").alias("query_id"), "vec")
    assert [(r["id"], r["rank"]) for r in R.cosine_top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1), (5, 2)]


def test_sync(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None), (None, "1")], "path string, h string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1"), ("r", None)], "path string, h string")
    changes = sync.compare(a, b, "path", "h")
    assert {r["path"]: r["status"] for r in changes.collect()} == {"p": "unchanged", "q": "modified", "r": "unchanged", "s": "added"}
    fresh = {(r["path"], r["h"]) for r in sync.replace_rows(a, b, changes, "path").where("path IS NOT NULL").collect()}
    assert fresh == {("p", "1"), ("q", "2"), ("r", None), ("s", "1")}


def test_budget_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1), ("h", 1, None)], "g string, o int, n int")
    got = {(r["g"], r["o"]) for r in sync.within_budget(df, ["g"], [F.col("o")], F.col("n"), 10).collect()}
    assert got == {("g", 1), ("h", 1)}


def test_diff(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n+b\n-c\n+d\n e\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+one\n+two\n"
    got = {(r["path"], r["is_new"], r["line"]) for r in ingest.parse_diff(spark.createDataFrame([(1, text)], "diff_id int, text string")).collect()}
    assert got == {("x.py", False, 2), ("x.py", False, 3), ("new.py", True, 1), ("new.py", True, 2)}


def test_python_extraction_and_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nclass A(Base):\n    '''Doc.'''\n    def go(self):\n        self.x = helper()\n        raise ValueError('x')\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("x = 1\n")
    files = ingest.scan(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.py"]
    rows = ingest.extract_python(files.select("path", "text").union(spark.createDataFrame([("bad.py", "def ("), ("none.py", None)], "path string, text string")))
    got = {(r["kind"], r["source_name"], r["target_name"]) for r in ingest.same_file_confidence(rows).collect()}
    assert {("extends", "A", "Base"), ("call", "A.go", "helper"), ("raises", "A.go", "ValueError"), ("writes", "A.go", "x")} <= got
    assert {r["name"] for r in rows.where("row_kind = 'symbol'").collect()} == {"A", "A.go"}


def test_scalars(spark):
    df = spark.createDataFrame([("HTTPServer.getURLPath_v2", "/a/b/c.py", "/a/b/d/e.py")], "n string, p string, q string")
    r = df.select(T.split_identifier(F.col("n")).alias("w"), T.bare_name(F.col("n")).alias("b"), T.owner_name(F.col("n")).alias("o"), T.shared_folders(F.col("p"), F.col("q")).alias("s"), T.normal_route(F.lit("users/:id//x/")).alias("r"), T.slug(F.lit("A  b-C!")).alias("g")).first()
    assert r["w"] == ["http", "server", "get", "url", "path", "v2"] and r["b"] == "getURLPath_v2" and r["o"] == "HTTPServer"
    assert r["s"] == 3 and r["r"] == "/users/{param}/x" and r["g"] == "a-b-c"
    assert T.glob_to_regex("*/[!a]?.py") == "(?s)^.*/[^a].\\.py$"
