"""Hand-made cases of what the tables hold no example of."""

from pyspark.sql import functions as F

from graphloom.operators import evidence as E
from graphloom.operators import graph as G
from graphloom.operators import report as P
from graphloom.operators import store
from graphloom.operators.search import Search, graph_search, recipe
from graphloom.sources import documents as D
from graphloom.sources import languages

SYM = "id long, name string, qualified_name string, file_id long, kind string, start_line int, end_line int, visibility string, is_exported boolean, cluster_id long, decorators array<string>"
EDGE = "id long, source_name string, target_name string, kind string, file_id long, line int, confidence string, receiver string, synthesized_by string, provenance string"
FILE = "id long, path string, language string"


def sym(id, name, file_id=1, kind="function", start=1, end=9, qualified=None, visibility=None, exported=None, cluster=None, decorators=None):
    return (id, name, qualified, file_id, kind, start, end, visibility, exported, cluster, decorators)


def edge(id, source, target, kind="call", file_id=1, line=1, confidence="EXTRACTED", receiver=None, by=None, provenance=None):
    return (id, source, target, kind, file_id, line, confidence, receiver, by, provenance)


def tables(spark, symbols, edges, files):
    return spark.createDataFrame(symbols, SYM), spark.createDataFrame(edges, EDGE), spark.createDataFrame(files, FILE)


def test_test_edges_take_the_best_evidence(spark):
    files = [(1, "/r/src/a.py", "python"), (2, "/r/tests/test_a.py", "python"), (3, "/r/src/b.py", "python"), (4, ":synth", "synthetic")]
    symbols = [sym(1, "load"), sym(2, "save"), sym(3, "save", 3), sym(4, "test_load", 2), sym(5, "TestSave.test_save", 2, "method"), sym(6, "helper", 2), sym(7, "testSend", 2), sym(8, "send", 3)]
    edges = [edge(1, "test_load", "load", file_id=2, line=5), edge(2, "test_load", "load", file_id=2, line=3), edge(3, "TestSave.test_save", "save", "instantiates", 2, 9), edge(4, "test_load", "helper", file_id=2), edge(5, "helper", "load", file_id=2), edge(6, "x", "send", "import", 2, 1), edge(7, "test_load", "save", file_id=4)]
    s, e, f = tables(spark, symbols, edges, files)
    got = {(r["source_name"], r["target_name"]): (r["line"], r["confidence"], r["provenance"]) for r in E.test_edges(s, f, e).collect()}
    assert got == {("test_load", "load"): (3, "EXTRACTED", "test-call"), ("TestSave.test_save", "save"): (9, "AMBIGUOUS", "test-instantiates"), ("testSend", "send"): (1, "EXTRACTED", "test-import")}
    assert E.test_edges(s.limit(0), f, e).isEmpty()


def test_synthesis_channels(spark):
    symbols = [sym(1, "Base.run", kind="method"), sym(2, "Sub.run", kind="method"), sym(3, "Sub.stop", kind="method"), sym(4, "on_done"), sym(5, "Owner.flush", kind="method"), sym(6, "dup"), sym(7, "A.dup", kind="method")]
    edges = [edge(1, "Sub", "Base", "extends"), edge(2, "Sub", "Base", "extends"), edge(3, None, "Base", "extends")]
    sources = spark.createDataFrame([("a", "for cb in self.hooks:\n    cb(1)\nhooks.append(on_done)\nhooks.append(unknown)\nhooks.append(dup)\nother.append(flush)\n"), ("b", "bus.on('saved', flush)\nbus.emit('saved')\nbus.on('never', flush)\nx.onDone(on_done)\ny.fire('Done')\n"), ("c", None)], "path string, text string")
    s, e, _ = tables(spark, symbols, edges, [(1, "a", "python")])
    got = {(r["source_name"], r["target_name"], r["synthesized_by"]) for r in E.synthesised(s, e, sources).collect()}
    assert got == {("Base.run", "Sub.run", "interface-override"), ("hooks", "on_done", "closure-collection"), ("hooks", "dup", "closure-collection"), ("saved", "Owner.flush", "event-emitter"), ("Done", "on_done", "event-emitter")}
    many = [sym(100 + i, f"S{i:03}.run", kind="method") for i in range(60)] + [sym(1, "Base.run", kind="method")]
    s, e, _ = tables(spark, many, [edge(i, f"S{i:03}", "Base", "implements") for i in range(60)], [(1, "a", "python")])
    assert sorted(r["target_name"] for r in E.override_edges(s, e).collect()) == [f"S{i:03}.run" for i in range(40)]


def test_resolution_by_import_then_count_then_nearness(spark):
    files = [(1, "/r/app/main.py", "python"), (2, "/r/app/tools/io.py", "python"), (3, "/r/far/io.py", "python"), (4, "/r/web/a.ts", "typescript"), (5, "/r/web/lib/b.ts", "typescript"), (6, "/r/app/near.py", "python")]
    symbols = [sym(1, "read", 2), sym(2, "read", 3), sym(3, "once", 3), sym(4, "draw", 5), sym(5, "draw", 3), sym(6, "twin", 3), sym(7, "twin", 6)]
    edges = [edge(i, "m", t, file_id=f) for i, (t, f) in enumerate((("load", 1), ("once", 1), ("nowhere", 1), ("twin", 1), ("draw", 4), (None, 4)))]
    sources = spark.createDataFrame([("/r/app/main.py", "from app.tools.io import read as load, other\nimport os\n"), ("/r/web/a.ts", "import { draw } from './lib/b'\nimport D, { x } from 'react'\n")], "path string, text string")
    s, e, f = tables(spark, symbols, edges, files)
    got = {(r["file_id"], r["target_name"]): (r["confidence"], r["resolved_by"], r["best_candidate"]) for r in E.resolve_edges(e, s, f, sources).collect()}
    assert got == {
        (1, "load"): ("EXTRACTED", "import", "/r/app/tools/io.py"), (1, "once"): ("EXTRACTED", "name-count", None), (1, "nowhere"): ("INFERRED", "unresolved", None),
        (1, "twin"): ("AMBIGUOUS", "name-count", "/r/app/near.py"), (4, "draw"): ("EXTRACTED", "import", "/r/web/lib/b.ts"),
    }


def test_walk_seeds_and_other_names(spark):
    symbols = [sym(1, "S", kind="class"), sym(2, "S.start", kind="method"), sym(3, "S.stop", kind="method"), sym(4, "T.only", kind="method"), sym(5, "plain")]
    s, e, f = tables(spark, symbols, [edge(1, "caller", "start"), edge(2, "other", "S.stop"), edge(3, "testX", "caller", "tests")], [(1, "/r/a.py", "python")])
    names = lambda x: {r["match"] for r in G.seeds_of(s, spark.createDataFrame([(x,)], "name string")).collect()}
    assert names("S") == {"S", "start", "stop", "S.start", "S.stop"} and names("S.start") == {"S.start", "start"} and names("only") == {"only", "T.only"} and names("plain") == {"plain"} and names("absent") == {"absent"}
    got = {(r["direction"], r["name"]) for r in G.blast_radius(e, s, f, "S").collect()}
    assert got == {("upstream", "caller"), ("upstream", "other")}
    path = [(r["src"], r["dst"]) for r in G.trace_by_names(e, s, "caller", "S").collect()]
    assert path == [("caller", "S")]


def plain_louvain(nodes, links, sweeps=100):
    near = {n: set() for n in nodes}
    for a, b in links:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    deg = {n: len(near[n]) for n in nodes}
    m = sum(deg.values()) // 2
    own, total = {n: n for n in nodes}, dict(deg)
    for _ in range(sweeps):
        moved = False
        for n in sorted(nodes):
            c = own[n]
            total[c] -= deg[n]
            k = {c: 0}
            for x in near[n]:
                k[own[x]] = k.get(own[x], 0) + 1
            best = min(k, key=lambda y: (-(2 * m * k[y] - total[y] * deg[n]), y))
            moved |= best != c
            own[n] = best
            total[best] += deg[n]
        if not moved:
            break
    return own


def test_communities_count_the_links_of_the_whole_graph(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(7)]
    cliques = [(f"k{c}{i}", f"k{c}{j}") for c in range(12) for i in range(5) for j in range(i)]
    links = chain + cliques
    adj = G.adjacency(spark.createDataFrame([(a, b, "call") for a, b in links], "source_name string, target_name string, kind string"))
    got = {r["name"]: r["community"] for r in G.communities(adj).collect()}
    want = plain_louvain({x for p in links for x in p}, links)
    groups = lambda d: {frozenset(n for n in d if d[n] == c) for c in d.values()}
    assert groups(got) == groups(want)
    assert len({got[f"a{i}"] for i in range(8)}) < len({x for x in plain_louvain({y for p in chain for y in p}, chain).values()} | {"-"})


def test_clusters_number_and_label(spark):
    symbols = [sym(i, n, file_id=1 if n < "n" else 2) for i, n in enumerate(["a", "b", "c", "x", "y", "z", "lone"])]
    edges = [edge(i, *p) for i, p in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")])]
    s, e, f = tables(spark, symbols, edges, [(1, "/r/render/src/f.py", "python"), (2, "/r/query/g.py", "python")])
    rows, members = G.clusters(e, s, f)
    got = {r["cluster_id"]: (r["label"], r["size"], round(r["cohesion"], 3)) for r in rows.collect()}
    assert got == {0: ("render — c", 3, 0.857), 2: ("query — x", 3, 0.857)} and members.count() == 6


def test_communities_are_those_of_names_moving_one_by_one_whatever_the_size(spark):
    import random

    draw = random.Random(7)
    links = sorted({tuple(sorted(draw.sample([f"n{i:03}" for i in range(120)], 2))) for _ in range(400)})
    adj = G.adjacency(spark.createDataFrame([(a, b, "call") for a, b in links], "source_name string, target_name string, kind string"))
    groups = lambda d: {frozenset(n for n in d if d[n] == c) for c in d.values()}
    want = groups(plain_louvain({x for p in links for x in p}, links))
    for most in (0, 500_000):
        assert groups({r["name"]: r["community"] for r in G.communities(adj, max_links=most).collect()}) == want


def test_clusters_take_the_same_edges_of_few_and_of_many_names(spark):
    pair = [sym(1, "a"), sym(2, "b")]
    for more in (0, 1200):
        s, e, f = tables(spark, pair + [sym(10 + i, f"lone{i}") for i in range(more)], [edge(1, "a", "b", confidence="INFERRED")], [(1, "/r/x/f.py", "python")])
        assert [(r["cluster_id"], r["size"], r["cohesion"]) for r in G.clusters(e, s, f)[0].collect()] == [(0, 2, 1.0)]
        assert G.clusters(e, s, f, trusted=True)[1].isEmpty()


def test_changes_find_symbols_and_their_tests(spark):
    files = [(1, "/r/a.py", "python"), (2, "/r/tests/test_b.py", "python"), (3, "/r/new.py", "python")]
    s, e, f = tables(spark, [sym(1, "f", start=1, end=200), sym(2, "g", start=120, end=130), sym(3, "test_f", 2), sym(4, "h", 3)], [edge(1, "mid", "g"), edge(2, "test_f", "mid", file_id=2), edge(3, "g", "g")], files)
    lines = spark.createDataFrame([("/r/a.py", 125, False), ("/r/a.py", 500, False), ("/r/new.py", 1, True), (None, 1, False)], "path string, line int, is_new boolean")
    assert {(r["path"], r["name"]) for r in E.changed_symbols(lines, s, f).collect()} == {("/r/a.py", "f"), ("/r/a.py", "g"), ("/r/a.py", None), ("/r/new.py", "h")}
    hit = E.change_impact(lines, s, f, e)
    assert {(r["name"], r["distance"]) for r in hit.collect()} == {("mid", 1), ("test_f", 2)} and E.change_risk(hit).first()["risk"] == "high"
    assert [tuple(r) for r in E.affected_tests(spark.createDataFrame([("/r/a.py",)], "path string"), s, f, e).collect()] == [("/r/tests/test_b.py", False, 1)]
    assert E.change_risk(hit.limit(0)).first()["risk"] == "low"


def test_affected_names_lead_to_another_seed(spark):
    links = [("t", "a"), ("a", "b"), ("b", "a"), ("c", "c"), ("u", "c"), ("v", "u"), ("w", "v"), ("x", "w"), ("s", "a"), ("s", "c")]
    adj = G.adjacency(spark.createDataFrame([(a, b, "call") for a, b in links], "source_name string, target_name string, kind string"))
    for names in ([], ["a"], ["a", "b"], ["c"], ["a", "c", "s"], ["b", "c", None]):
        seeds = spark.createDataFrame([(n,) for n in names], "name string")
        many = E.walk_many(adj.withColumn("rank", F.lit(2)), seeds).select("name").distinct()
        assert sorted(r["name"] for r in E.reached_by_others(adj, seeds).collect()) == sorted(r["name"] for r in many.collect())


def test_affected_tests_keep_a_row_a_name(spark, monkeypatch):
    kept = []
    real = E.cut
    monkeypatch.setattr(E, "cut", lambda df: kept.append(real(df)) or kept[-1])
    n = 30
    s, e, f = tables(spark, [sym(i, f"f{i:02}") for i in range(n)] + [sym(99, "test_f", 2)], [edge(1, "test_f", "mid")] + [edge(2 + i, "mid", f"f{i:02}") for i in range(n)], [(1, "/r/a.py", "python"), (2, "/r/tests/test_b.py", "python")])
    assert [tuple(r) for r in E.affected_tests(spark.createDataFrame([("/r/a.py",)], "path string"), s, f, e, depth=3).collect()] == [("/r/tests/test_b.py", False, 1)]
    assert max(df.count() for df in kept) <= n + 2


def test_best_reach_is_that_of_walking_from_every_root():
    import random

    import numpy as np

    draw = random.Random(3)
    links = sorted({(a, b) for a, b in ((draw.randrange(90), 30 + draw.randrange(90)) for _ in range(260)) if a != b})
    near = {a: {b for x, b in links if x == a} for a, _ in links}

    def walked(i):
        seen = at = {i}
        for _ in range(3):
            at = {b for a in at for b in near.get(a, ())} - seen
            seen = seen | at
        return len(seen) - 1

    root = np.arange(60)
    weight = np.array([draw.choice([1.0, 1.5, 0.0, -1.0]) for _ in root])
    want = sorted((-weight[i] * walked(i), i, walked(i)) for i in root if i in near and all(b != i for _, b in links))[:12]
    assert G._best_reach(*np.array(links).T, root, weight, 12, 3) == want
    none = np.zeros(0, np.int64)
    assert G._best_reach(none, none, none, none, 5, 3) == []


def test_search_checks_and_recipes(spark):
    import pytest

    s, e, f = tables(spark, [sym(1, "f"), sym(2, None)], [edge(1, "g", "f"), edge(2, None, None)], [(1, "/r/a.py", "python")])
    for bad in (Search(kind="x"), Search(limit=-1), Search(edge_kind="call,odd"), Search(sort="up")):
        with pytest.raises(ValueError):
            graph_search(s, e, f, bad)
    assert [(r["symbol"], r["incoming"], r["total"]) for r in graph_search(s, e, f, Search(name_pattern="?", min_in_degree=1)).collect()] == [("f", 1, 1)]
    assert recipe("dead-code-suspects", kind="class").kind == "class" and recipe("dead-code-suspects").checked().max_in_degree == 0
    assert graph_search(s.limit(0), e, f, Search()).isEmpty()


def test_routes_config_and_containers(spark):
    texts = spark.createDataFrame([
        ("/r/api.py", "app = FastAPI()\nKEY = os.getenv('DB_URL')\n# os.getenv('NOT')\ndef f():\n    requests.get('http://localhost:8/items//{id}?x=1')\n    httpx.post('https://other.example/x')\n"),
        ("/r/web.ts", "const app = express()\napp.get('/users/:id', show)\nconst r = fetch('/api/x', { method: 'PUT' })\nfunction g() {\n  return axios({ url: '/a', method: 'POST' })\n}\nother.get('/no', x)\n"), ("/r/n.py", None),
    ], "path string, text string")
    files = spark.createDataFrame([(1, "/r/api.py", "python"), (2, "/r/web.ts", "typescript")], FILE)
    symbols = spark.createDataFrame([sym(1, "f", 1, start=4, end=6), sym(2, "g", 2, start=3, end=6)], SYM)
    with_path = spark.createDataFrame([("/r/api.py", "f", ['@app.get("/items/{id}")', '@app.api_route("/x", methods=["GET", "POST"])', '@cached.get("/no")'], 4)], "path string, name string, decorators array<string>, start_line int")
    assert {r["route"] for r in D.python_routes(with_path, texts).collect()} == {"ROUTE GET /items/{param}", "ROUTE GET /x", "ROUTE POST /x"}
    assert {(r["route"], r["handler"]) for r in D.script_routes(texts).collect()} == {("ROUTE GET /users/{param}", "show")}
    calls = D.http_calls(texts, files, symbols)
    assert {(r["source_name"], r["route"]) for r in calls.collect()} == {("f", "ROUTE GET /items/{param}"), ("g", "ROUTE PUT /api/x"), ("g", "ROUTE POST /a")}
    assert {(r["key"], r["symbol"], r["target"]) for r in D.config_reads(texts, files, symbols).collect()} == {("DB_URL", None, "CONFIG DB_URL")}
    env = spark.createDataFrame([("e", "export A=1\nREDIS_URL=redis://x\n# no\nEMPTY=\n")], "path string, text string")
    assert {(r["key"], r["value_category"], r["resource"]["category"] if r["resource"] else None) for r in D.env_keys(env).collect()} == {("A", "number", None), ("REDIS_URL", "url", "cache"), ("EMPTY", "empty", None)}
    js = spark.createDataFrame([("j", '{"a": {"b": 1, "c": "x"}, "d": true}'), ("k", "no json")], "path string, text string")
    assert {r["key"] for r in D.json_keys(js).collect()} == {"a.b", "a.c", "d"}
    docker = spark.createDataFrame([("d", "FROM python:3 AS build\nENV A=1 B=2\nARG C\nFROM build\nCOPY --from=build /x /y\nEXPOSE 80 443/tcp\n")], "path string, text string")
    assert {(r["category"], r["name"], r["stage"]) for r in D.dockerfile(docker).collect()} == {("image", "python:3", "build"), ("stage", "build", "build"), ("config", "A", "build"), ("config", "B", "build"), ("config", "C", "build"), ("copy", "build", None), ("port", "80", None), ("port", "443", None)}
    comp = spark.createDataFrame([("c", "version: '3'\nservices:\n  web:\n    image: nginx\n    ports:\n      - \"80:80\"\n    environment:\n      - K=v\n  db:\n    image: pg\n    volumes:\n      - data:/x\nvolumes:\n  data:\n")], "path string, text string")
    assert {(r["service"], r["category"], r["name"]) for r in D.compose(comp).collect()} == {("web", "service", "web"), ("web", "image", "nginx"), ("web", "port", "80:80"), ("web", "config", "K"), ("db", "service", "db"), ("db", "image", "pg"), ("db", "volume", "data")}
    routes = spark.createDataFrame([("b", "ROUTE GET /x"), ("a", "ROUTE GET /x")], "repo string, route string")
    callers = spark.createDataFrame([("a", "f", "ROUTE GET /x"), ("a", "f", "ROUTE GET /none")], "repo string, source_name string, route string")
    assert {(r["route_repo"], r["derived"]) for r in D.cross_repository_callers(callers, routes).collect()} == {("b", True), ("a", False)}
    assert [tuple(r) for r in D.shared_keys(spark.createDataFrame([("a", "x-y"), ("b", "X_Y"), ("b", "z")], "repo string, key string")).collect()] == [("X_Y", 2)]


def test_issue_numbers_and_document_edges(spark):
    docs = spark.createDataFrame([(1, "# A <b>x</b> #\nsee #12 and a#3 [up](docs/x.md#t) [w](https://e.x) `/api/x` `A_KEY`\npassword: abc\nplain"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["target_kind"], r["target_value"]) for r in D.references(docs).collect()} == {("issue", "12"), ("doc", "docs/x.md"), ("route", "/api/x"), ("config", "A_KEY")}
    a = D.anchors(docs).collect()
    assert len(a) == 1 and a[0]["heading_path"] == "A x" and "password" not in a[0]["search_text"] and "plain" in a[0]["search_text"]


def test_languages():
    cases = {
        "go": ("package a\nimport (\n\t\"fmt\"\n)\ntype Box struct { n int }\nfunc (b *Box) Open(x string) error { fmt.Println(x); return run(x) }\nfunc run(s string) error { return nil }\n", {("Box", "struct"), ("Box.Open", "method"), ("run", "function")}, {("call", "Box.Open", "run"), ("import", "f", "fmt")}),
        "java": ("import a.b.C;\npublic class A extends B implements I, J<K> {\n  /** Doc. */\n  @Override\n  public int go(String s) throws X { if (s == \"}{\") { throw new BadError(); } return new C().run(); }\n}\n", {("A", "class"), ("A.go", "method")}, {("extends", "A", "B"), ("implements", "A", "I"), ("implements", "A", "J"), ("instantiates", "A.go", "C"), ("raises", "A.go", "BadError"), ("import", "f", "C")}),
        "rust": ("use std::io::Read;\npub struct S;\nimpl T for S {\n    fn a(&self) -> u8 { helper() }\n}\nfn helper() -> u8 { 1 }\n", {("S", "struct"), ("S.a", "method"), ("helper", "function")}, {("implements", "S", "T"), ("call", "S.a", "helper"), ("import", "f", "Read")}),
        "typescript": ("import { x } from './x'\nexport class A extends B {\n  private run(a: string): void { x(a.replace(/[({]/g, '')) }\n}\nexport const f = async (a: number) => { return new A() }\nfunction g() { throw new OddError() }\n", {("A", "class"), ("A.run", "method"), ("f", "function"), ("g", "function")}, {("extends", "A", "B"), ("call", "A.run", "x"), ("instantiates", "f", "A"), ("raises", "g", "OddError"), ("import", "f", "x")}),
        "csharp": ("using System.Text;\nclass A : B {\n  public int Go(int x) { return Run(x); }\n  static int Run(int y) { return y; }\n}\n", {("A", "class"), ("A.Go", "method"), ("A.Run", "method")}, {("extends", "A", "B"), ("call", "A.Go", "Run"), ("import", "f", "Text")}),
        "ruby": ("require 'set'\nclass A < B\n  def go(x)\n    raise OddError if x\n    run(x)\n  end\nend\ndef run(x)\nend\n", {("A", "class"), ("A.go", "method"), ("run", "function")}, {("extends", "A", "B"), ("call", "A.go", "run"), ("raises", "A.go", "OddError"), ("import", "f", "set")}),
        "php": ("<?php\nuse App\\Tool;\nclass A extends B implements I {\n  private function go($x) { return run($x); }\n}\nfunction run($x) { return new Tool(); }\n", {("A", "class"), ("A.go", "method"), ("run", "function")}, {("extends", "A", "B"), ("implements", "A", "I"), ("call", "A.go", "run"), ("instantiates", "run", "Tool"), ("import", "f", "Tool")}),
        "swift": ("import Foundation\nclass A: B {\n  func go(x: Int) { run(x) }\n}\nfunc run(_ x: Int) {}\n", {("A", "class"), ("A.go", "method"), ("run", "function")}, {("extends", "A", "B"), ("call", "A.go", "run"), ("import", "f", "Foundation")}),
        "c": ("#include <stdio.h>\nstruct box { int n; };\nstatic int run(int x) {\n  return x;\n}\nint main(void) {\n  return run(1);\n}\n", {("box", "struct"), ("run", "function"), ("main", "function")}, {("call", "main", "run"), ("import", "f", "stdio")}),
        "cpp": ("#include \"a/b.h\"\nclass A : public B {\n  int go(int x) { return run(x); }\n};\nint A::stop() { return run(2); }\nint run(int x) { return x; }\n", {("A", "class"), ("A.go", "method"), ("A.stop", "method"), ("run", "function")}, {("call", "A.go", "run"), ("call", "A.stop", "run"), ("import", "f", "b")}),
        "javascript": ("class A { go(x) { return `}${run(x)}` + run(x) } }\nvar run = function (x) { return x }\n", {("A", "class")}, set()),
    }
    for name, (text, symbols, edges) in cases.items():
        rows = languages.rows_of("/r/f.x", text, name)
        got = {(r["name"], r["kind"]) for r in rows if r["row_kind"] == "symbol"}
        assert symbols <= got if name == "javascript" else symbols == got, (name, got)
        links = {(r["kind"], r["source_name"], r["target_name"]) for r in rows if r["row_kind"] == "edge"}
        assert edges <= links, (name, edges - links, links)
        assert languages.rows_of("/r/f.x", "", name) == [] and isinstance(languages.rows_of("/r/f.x", text[: len(text) // 2], name), list)


def test_extract_all_languages(spark):
    df = spark.createDataFrame([("a.py", "python", "class A:\n    x: Box\n    def f(self, b: Tool):\n        self.n += 1\n        return Thing(b)\n"), ("a.go", "go", "package a\nfunc F() {}\n"), ("n.go", "go", None), ("e.go", "go", ""), ("q.sql", "sql", "select 1")], "path string, language string, text string")
    rows = languages.extract(df).collect()
    assert {(r["path"], r["name"]) for r in rows if r["row_kind"] == "symbol"} == {("a.py", "A"), ("a.py", "A.x"), ("a.py", "A.f"), ("a.go", "F")}
    assert {("holds", "A", "Box"), ("uses", "A.f", "Tool"), ("instantiates", "A.f", "Thing"), ("writes", "A.f", "n"), ("reads", "A.f", "n")} <= {(r["kind"], r["source_name"], r["target_name"]) for r in rows if r["row_kind"] == "edge"}


def test_store_changes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"k{i % 20}", "old") for i in range(100)] + [(900, None, "null")], "id long, path string, v string")
    store.create(rows, path, "path", 8)
    assert store.read(spark, path).count() == 101
    n = store.change(path, "path", spark.createDataFrame([("k1",), (None,)], "path string"), spark.createDataFrame([(500, "k2", "new", 7)], "id long, path string, v string, more int"), 8)
    got = store.read(spark, path)
    assert n <= 3 and got.count() == 101 - 5 - 5 - 1 + 1 and got.where("path = 'k2'").first()["more"] == 7 and got.where("path = 'k1' OR path IS NULL").isEmpty()
    assert store.change(path, "path", got.select("path").limit(0), None, 8) == 0
    store.handler(path, "path", "gone", 8)(spark.createDataFrame([(1, "k3", None, None, True), (2, "k4", "w", None, False)], "id long, path string, v string, more int, gone boolean"), 0)
    assert store.read(spark, path).where("path = 'k3'").isEmpty() and store.read(spark, path).where("path = 'k4'").count() == 1
    e = str(tmp_path / "e")
    store.put_channel(spark.range(3), e, "tests")
    store.put_channel(spark.range(5), e, "synthesis")
    store.put_channel(spark.range(1), e, "tests")
    assert spark.read.parquet(e).count() == 6
    assert sorted(r["value"] for r in store.as_lines(rows.limit(0).unionByName(spark.createDataFrame([(1, "b", None), (2, None, None)], rows.schema)), "path").collect()) == ["b"]
    assert store.as_json(spark.createDataFrame([(1, None)], "a int, b int")).first()["value"] == '{"a":1}'
    calls = spark.createDataFrame([("x", 5.0), ("y", 500.0), ("z", None)], "tool string, elapsed_ms double")
    store.append_slow(calls, str(tmp_path / "slow"))
    store.append_slow(calls, str(tmp_path / "slow"))
    assert spark.read.json(str(tmp_path / "slow")).count() == 2


def test_layout_is_bounded_and_repeatable(spark):
    symbols = [sym(i, f"n{i}", cluster=i % 3) for i in range(30)]
    edges = [edge(i, f"n{i}", f"n{(i * 7 + 1) % 30}") for i in range(30)]
    s, e, _ = tables(spark, symbols, edges, [(1, "a", "python")])
    a, b = (sorted(map(tuple, P.layout(e, s, 10).collect())) for _ in range(2))
    assert a == b and len(a) == 10 and all(abs(x) < 1e4 for r in a for x in r[3:])
    assert P.cluster_spheres(P.layout(e, s, 10)).count() <= 3 and P.layout(e.limit(0), s, 10).isEmpty()


def test_flow_tree_claims_siblings_first(spark):
    e = spark.createDataFrame([edge(i, *p) for i, p in enumerate([("r", "a"), ("r", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "r"), ("d", "e")])], EDGE)
    s = spark.createDataFrame([], SYM)
    assert {(r["name"], r["parent"], r["depth"], r["truncated"]) for r in G.flow_tree(e, s, "r", depth=2).collect()} == {("a", "r", 1, False), ("b", "r", 1, False), ("c", "a", 2, False), ("d", "b", 2, True)}
    assert {r["name"] for r in G.flow_tree(e, s, "r", depth=3, breadth=1).collect()} == {"a", "b", "d"} and G.flow_tree(e, s, "absent").isEmpty()


def test_flow_tree_looks_past_callees_that_others_claimed(spark):
    # the names that b calls first are all claimed below a before b is visited
    taken = [f"c{i:02}" for i in range(12)]
    links = [("r", "a"), ("r", "b"), ("a", "d"), ("a", "e"), *(("d", x) for x in taken[:6]), *(("e", x) for x in taken[6:])]
    links += [("b", x) for x in taken] + [("b", "z")]
    e = spark.createDataFrame([edge(i, *p) for i, p in enumerate(links)], EDGE)
    got = {(r["name"], r["parent"]) for r in G.flow_tree(e, spark.createDataFrame([], SYM), "r", breadth=6).collect()}
    assert got == {(t, s) for s, t in links if s != "b"} | {("z", "b")}


def test_hot_keys_and_outliers_in_percentiles(spark):
    from graphloom.operators.skew import key_percentiles

    rows = [("hot", i) for i in range(3000)] + [("hot", 10**15)] + [("cold", 5), ("cold", None), (None, 7)]
    got = {r["key"]: (r["p50"], r["p100"]) for r in key_percentiles(spark.createDataFrame(rows, "k string, v long"), "k", "v", [0.5, 1.0]).collect()}
    assert got == {"hot": (1500, 10**15), "cold": (5, 5), None: (7, 7)}
