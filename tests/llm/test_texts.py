import random

import pytest

from graphloom.llm import docpairs, leakage, packing, parse, pii, written


# ---------------------------------------------------------------- packing
def test_best_two_fit_never_overfills_and_places_all():
    rng = random.Random(2)
    for cap in (10, 97, 512):
        sizes = [rng.randint(1, cap) for _ in range(700)]
        bins = packing.best_two_fit(sizes, cap)
        load = {}
        for s, b in zip(sizes, bins, strict=True):
            load[b] = load.get(b, 0) + s
        assert max(load.values()) <= cap and len(bins) == len(sizes)
        assert len(load) <= sum(sizes) / cap * 1.12 + 2
    assert packing.best_two_fit([], 5) == [] and len(set(packing.best_two_fit([5, 5, 5], 5))) == 3


def test_two_replace_the_smallest():
    # 6 and 3 leave 1 of 10; the 3 gives way to 2 + 2, which fill the bin
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 4), (3, 6), (4, 0), (5, 10), (5, 10)], "id long, tokens long")
    caps = spark.createDataFrame([("a", 10), ("b", None), ("c", 0)], "budget_name string, capacity_tokens int")
    rows = packing.pack(sizes, caps).collect()
    assert {r["budget_name"] for r in rows} == {"a"}
    load, pieces = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        pieces.setdefault(r["id"], []).append((r["start"], r["tokens"]))
    assert max(load.values()) <= 10 and sorted(pieces[1]) == [(0, 10), (10, 10), (20, 5)] and 4 not in pieces and len(pieces[5]) == 2


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x " * 50_000)], "doc_id long, text string")
    got = {r["id"]: r["tokens"] for r in packing.token_sizes(df, "doc_id", "text").collect()}
    assert got[1] in (2, 3) and set(got) == {1, 4} and got[4] > 40_000


# ---------------------------------------------------------------- hand-written or not
@pytest.mark.parametrize(
    ("path", "text", "reason"),
    [
        ("/r/src/a.py", "# Not generated, safe to edit.\nimport os\n", None),
        ("/r/src/a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n", "generated"),
        ("/r/src/a.js", "/*\n * Automatisch erzeugt, bitte nicht bearbeiten.\n */\nlet a = 1;\n", "generated"),
        ("/r/src/a.py", "def f():\n    '''TODO Auto-generated method stub: do not edit'''\n", None),
        ("/r/vendor/x/a.go", "package a\n", "third_party"),
        ("/r/app/vendors/a.go", "package a\n", None),
        ("/r/src/a.c", "/*! Copied from the zed project, version 1.2; Apache License 2.0 */\nint a;\n", "third_party"),
        ("/r/src/a.min.js", None, "compacted"),
        ("/r/package-lock.json", "{}", "generated"),
        ("/r/src/t.py", "T = [\n" + "".join(f"{i}, {i * 7},\n" for i in range(90)) + "]\n", "data"),
        ("/r/src/c.py", "A = 1\nB = 2\nC = 3\n", None),
        ("/r/src/m.js", "var a=function(b){return b&&b.c?1:2};" * 40, "compacted"),
        ("/r/src/e.py", "", None),
    ],
)
def test_reason(path, text, reason):
    assert written.judge(path, text)[0] == reason


def test_copies_of_third_party_code(spark):
    body = "package a\n" + "".join(f"func F{i}() int {{ return {i} }}\n" for i in range(9))
    files = spark.createDataFrame([(1, "/r/vendor/a.go"), (2, "/r/src/b.go"), (3, "/r/src/c.go"), (4, None), (5, ":synth/0"), (6, "/r/vendor/none.go")], "id long, path string")
    sources = spark.createDataFrame([("/r/vendor/a.go", body), ("/r/src/b.go", "// ours\n" + body.replace("\n", "\r\n")), ("/r/src/c.go", body + "// more\n")], "path string, text string")
    got = {r["id"]: r["reason"] for r in written.not_handwritten(files, sources).collect()}
    assert got == {1: "third_party", 2: "third_party", 6: "third_party"}
    assert written.not_handwritten(files.limit(0), sources).isEmpty()


# ---------------------------------------------------------------- syntax
GOOD = {
    "python": "import os\n\n@d\ndef f(a, *b, c: int = 1, **k) -> str:\n    '''x'''\n    try:\n        return [i for i in a if i] or {1: 2, **k}\n    except (A, B) as e:\n        raise X from e\n    finally:\n        pass\n\nclass A(B):\n    x: int = 3\n    def g(self): return lambda y: y[1:2]\n",
    "javascript": "import a, { b } from './x';\nexport default class A extends B { static #p = 1; get x() { return `a ${this.y ? `b${1}` : '}'}`; } }\nconst f = async (a, { b = 1, ...c }) => a?.b ?? c;\nfor (const k of x) { if (/[({]+/.test(k)) break; else continue }\nlet z = a\n  ? b : c\nlabel: while (true) { x++ }\nfoo()\nbar()\n",
    "typescript": "import type { A } from './a';\nexport interface P<T extends A = B> { readonly a?: string; b(x: number[]): Promise<T>; [k: string]: unknown }\ntype U = 'a' | 'b' | Record<string, Array<number>>;\nexport abstract class C<T> implements P<T> { constructor(private readonly x: Map<string, Set<T>>) { super(); } get y(): T | undefined { return this.x! as unknown as T; } }\nenum E { A = 1, B }\nexport const g = <T,>(x: T): x is T => true;\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T) F(xs ...int) (n int, err error) {\n\tfor i, v := range xs {\n\t\tswitch {\n\t\tcase v > 1:\n\t\t\tn++\n\t\tdefault:\n\t\t\tgo func() { ch <- v }()\n\t\t}\n\t}\n\tm := map[string][]int{\"a\": {1, 2}}\n\tif v, ok := m[\"a\"]; !ok {\n\t\treturn 0, fmt.Errorf(\"%v\", v)\n\t}\n\treturn\n}\n\nconst A = 1\nvar b = []struct{ x int }{{1}}\n",
    "java": "package a.b;\nimport java.util.*;\n@X(a = 1)\npublic final class A<T extends B & C> extends D<T> implements E, F {\n  private static final Map<String, List<Integer>> M = new HashMap<>();\n  static { M.put(\"a\", null); }\n  public <K> K f(final int... xs) throws G, H {\n    for (var x : xs) { if (x > 1 && o instanceof String s) continue; }\n    int[] a = {1, 2}; char c = '{';\n    try (R r = open()) { return (K) a.clone(); } catch (I | J e) { throw new K(e); } finally { }\n  }\n  enum Z { P(1) { int q() { return 1; } }, Q; }\n}\n",
    "c": "#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct node { int a : 3; struct node *next; } node_t;\nstatic const char *names[] = { \"a\" \"b\", [2] = \"c\" };\nint main(int argc, char **argv) {\n  for (size_t i = 0; i < sizeof(struct node); i++) { if (!p->x || *q == '}') goto end; }\n  int (*fp)(int, void *) = (int (*)(int, void *)) f;\nend:\n  return a ? b : -1;\n}\n",
    "rust": "#![allow(x)]\nuse a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: A + 'a> where T: B { pub x: &'a [T], y: Option<Box<dyn Fn(i32) -> u8>> }\nimpl<'a, T> Tr for S<'a, T> {\n  const N: usize = 3;\n  fn f(&mut self, (a, b): (i32, u8)) -> Result<(), E> {\n    let r = r#\"a \"{ \"#; let c = 'x'; let n = 1..=5;\n    match self.x { Some(ref v) if *v > 1 => { v? } [a, .., b] => b as u64, _ => return Err(e), };\n    for i in 0..10 { println!(\"{:?}\", i); }\n    if let Some(x) = y { x } else { z };\n    Ok(v.iter().map(|x| x + 1).collect::<Vec<_>>())\n  }\n}\n",
}
BAD = {
    "python": ["def f(:\n    pass\n", "def f():\n", "x = '''abc\n", "if x\n    y()\n", "try:\n    x()\ny()\n", "a b c\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "def f():\n    return 1\n  x = 2\n"],
    "javascript": ["function f() {\n", "const x = ;\n", "foo(]);\n", "a b\n", "x = `abc\n", "export async function na", "import { a }", "=======\n", "CREATE TABLE a (\n  b INTEGER NOT NULL\n);\n", "name: x\nsteps:\n  - run: a b\n", "<html><body>a</body></html>"],
    "typescript": ["function f(a: string[] {\n}\n", "let x: = 1;\n", "# Notes\n\nSome words on it\n"],
    "go": ["package a\n\nfunc f() {\n", "package a\n\nfunc f() int\n\treturn 1\n}\n", "#!/bin/sh\nset -eu\n", "package a\n\nx := 1 2\n", "use a::*;\n"],
    "java": ["public class A {\n  void f() {\n", "public class A { int x = ; }", "#include <a.h>\nint a;\n", "class A { void f() { g(; } }"],
    "c": ["int main() {\n", "int f(void) { return 0; ]\n", "Some words on the matter\n", "int x = 'a;\n", "int a\n"],
    "rust": ["fn f() {\n", "package a.b;\nclass A { }\n", "let x = 1;\n", "fn f() { let x = \"abc }\n", "CREATE TABLE a (b INTEGER);\n"],
}


def flagged(spark, rows):
    return {r["id"] for r in parse.syntax_errors(spark.createDataFrame(rows, "id long, language string, text string")).collect()}


def test_valid_files_parse(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate(GOOD.items())]
    rows += [(100 + i, k, t.replace("\n", "\r\n")) for i, (k, t) in enumerate(GOOD.items())]
    rows += [(200, "python", ""), (201, "python", None), (202, "klingon", "((("), (203, None, "((("), (204, "c", "// only a comment ((("), (205, "javascript", "/*\n<<<<<<< x\n=======\n>>>>>>> y\n*/\nlet a = 1;\n")]
    assert flagged(spark, rows) == set()


def test_broken_files_are_flagged(spark):
    rows = [(1000 * i + j, k, t) for i, (k, ts) in enumerate(BAD.items()) for j, t in enumerate(ts)]
    assert {r[0] for r in rows} - flagged(spark, rows) == set()


def test_every_cut_of_a_class_body_is_flagged(spark):
    rows = []
    for i, (k, t) in enumerate(GOOD.items()):
        if k in ("java", "rust"):
            at = t.index("{", t.index("impl" if k == "rust" else "class"))
            rows += [(1000 * i + c, k, t[:c]) for c in range(at + 1, len(t) - 2, 17)]
    assert {r[0] for r in rows} == flagged(spark, rows)


def test_python_is_confirmed_exactly(spark):
    files = spark.createDataFrame([(1, "a.py", "python"), (2, "b.py", "python"), (3, "c.py", "python")], "id long, path string, language string")
    sources = spark.createDataFrame([("a.py", "x = (1\n"), ("b.py", "x = 1\n"), ("c.py", None)], "path string, text string")
    assert [r["id"] for r in parse.broken_files(files, sources).collect()] == [1]


# ---------------------------------------------------------------- documentation
@pytest.mark.parametrize(
    ("doc", "told"),
    [
        (None, False), ("", False), ("   ", False), ("TODO: document this", False), ("/**\n * @param a\n * @return\n */", False), ("Gets the user.", False), ("The get user method.", False), ("{@inheritDoc}", False), ("See base class.", False),
        ("_summary_\n\nArgs:\n    a (_type_): _description_\n\nReturns:\n    _type_: _description_", False), ("SPDX-License-Identifier: MIT", False), ("x = getUser(a)", False), ("if (a) return;", False), ("noqa: D103", False), ("--------", False), ("Lorem ipsum dolor sit amet.", False),
        ("Blocks until the lease is granted or ten seconds have passed.", True), ("Renvoie la première entrée encore valide, sinon une liste vide.", True), ("Entfernt alle veralteten Zeilen aus der Tabelle.", True), ("/** Get user.\n *\n * Falls back to the cached row when the store is down. */", True),
        ("// TODO(perf): revisit.\n//\n// Never throws: a broken row is logged and skipped instead.", True), ("<p>Drops rows that point outside the snapshot.</p>", True), ("wait " * 20_000 + "until every pending worker finished its shard", True),
    ],
)
def test_tells(doc, told):
    assert docpairs.tells(doc, "getUser", "User getUser(String a)") is told


def test_documentation_in_the_text():
    py = "@cache\ndef f(a,\n      b=':'):\n    '''Says it.'''\n\nasync def g(): return 1\n".split("\n")
    assert docpairs.doc_in_text(py, 1, "python") == "Says it." and docpairs.doc_in_text(py, 2, "python") == "Says it." and docpairs.doc_in_text(py, 6, "python") is None
    java = "/**\n * Says it.\n */\n@Override\npublic int f() {\n\n// far\n\nint g()".split("\n")
    assert "Says it." in docpairs.doc_in_text(java, 5, "java") and "Says it." in docpairs.doc_in_text(java, 4, "java") and docpairs.doc_in_text(java, 9, "java") is None
    assert docpairs.doc_in_text(java, 99, "java") is None and docpairs.doc_in_text([], None, "go") is None


def test_pairs_and_inheritance(spark):
    files = spark.createDataFrame([(1, "a.java", "java")], "id long, path string, language string")
    text = "/** Waits until every shard has answered the call. */\nint f() {\n}\n"
    sources = spark.createDataFrame([("a.java", text)], "path string, text string")
    schema = "id long, file_id long, name string, kind string, start_line int, end_line int, docstring string, signature string"
    rows = [(1, 1, "Base.f", "method", 2, 3, None, None), (2, 1, "Base.f", "method", 2, 3, None, None), (3, 1, "Sub.f", "method", 9, 9, "{@inheritDoc}", None), (4, 1, "Far.f", "method", 8, 8, None, None), (5, 1, "Loop.f", "method", 7, 7, None, None), (6, 1, "X", "class", 1, 1, "Some telling words about this thing.", None), (7, None, "y", "function", 1, 1, "Waits until every shard answered.", None)]
    docs = docpairs.documented(spark.createDataFrame(rows, schema), files, sources).cache()
    assert {r["id"] for r in docs.where("told").collect()} == {1, 2}
    assert docs.where("id = 1").first()["code"] == "int f() {\n}"
    edges = spark.createDataFrame([("Sub", "Base", "extends"), ("Far", "Sub", "implements"), ("Loop", "Pool", "extends"), ("Pool", "Loop", "extends"), ("Sub", "Base", "extends")], "source_name string, target_name string, kind string")
    got = {r["id"]: (r["documentation"], r["inherited_from"]) for r in docpairs.resolve_inherited(docs, edges).collect()}
    assert set(got) == {3, 4} and got[4][1] == "Base" and got[3][0].startswith("Waits until")


def test_typescript_is_no_javascript(spark):
    typed = [
        "interface Row {\n  id;\n}\n", "class A {\n  private size() { return 1; }\n}\n", "const f = (a: string) => a;\n", "function f(a, b: number) { return a; }\n", "const n: number = 1;\n",
        "class A {\n  size(): number { return 1; }\n}\n", "class A<T> { }\n", "function f<T>(a) { return a; }\n", "enum E { A, B }\n", "let x = y as Row;\n", "let x = y!.z;\n", "function f(a?) { return a; }\n",
        "declare const a;\n", "abstract class A { }\n", "class A implements B { }\n", "type A = B;\n", "let x = (y as Row[]);\n", "class A { readonly b = 1; }\n", "function f(a?: string[]): void { }\n",
    ]
    plain = [
        "import a, { b as c, default as d } from './x.js';\nimport * as ns from 'y';\nexport { c as e, d };\nexport * as z from 'z';\nexport * from 'w';\nexport default class { }\n",
        "const o = { a: 1, 'b': 2, [c]: d ? e : f, get g() { return 1; }, async h() { await i; }, set j(v) { }, async *k() { yield 1; }, type: 2, as: 3, of, ...p };\n",
        "class A extends B {\n  static x = 1;\n  #y;\n  static { init(); }\n  static async z(a, { b: c } = {}, [d] = []) { return a?.b ?? (c ? d : f(c)); }\n}\n",
        "for (const x of y) { if (a < b && c > (d)) continue; }\nfor await (const x of y()) g(x);\nouter: for (;;) { break outer; }\nswitch (f(x)) { case (1): { break; } default: g(); }\n",
        "const type = 1, as = 2, of = 3, namespace = 4, readonly = 5, declare = 6, module = 7;\nmodule.exports = { type, as };\nas = type ? f() : g;\nconst h = a ? (b) : (c) => d;\nlet k = [], l = async x => x, m = async (x) => { };\n",
        "async function f() { return await g(); }\nexport async function h() { }\nexport const q = 1, r = () => { };\nx = a ? function () { } : b;\nif (!a) delete b.c;\nlet t = `a${b}`, u = /x:[y]/g.test(v);\ny = x\n  ? f(a)\n  : g\n",
    ]
    rows = [(i, "javascript", t) for i, t in enumerate(typed)] + [(100 + i, "typescript", t) for i, t in enumerate(typed)] + [(200 + i, "javascript", t) for i, t in enumerate(plain)]
    got = {r["id"] for r in parse.syntax_errors(spark.createDataFrame(rows, "id long, language string, text string")).collect()}
    assert got == set(range(len(typed)))


# ---------------------------------------------------------------- leakage
def test_words_survive_markup_and_escapes():
    want = "the red fox jumps".split()
    for t in ("The red fox jumps.", "THE&nbsp;RED <em>fox</em> jumps", "the\\nred\\tfox \\u006aumps", "the **red** fox_jumps", "“the” red\u00ad fox—jumps", "the%20red%20fox%20jumps"):
        assert leakage.words_of(t) == want, t


def grams(ws):
    g = {}
    for k in range(len(ws) - 4):
        g.setdefault(tuple(ws[k : k + 5]), []).append(k)
    return g


def test_alignment_tolerates_one_word_in_eight():
    item = [f"w{i}" for i in range(60)]
    g = grams(item)
    hold = lambda p: leakage.aligned(item, g, ["x"] * 7 + p + ["y"] * 7)
    assert hold(item[10:22]) and not hold(item[10:21])
    assert hold(item[10:16] + ["z"] + item[17:22]) and hold(item[10:16] + ["z"] + item[16:22]) and hold(item[10:16] + item[17:23])
    assert not hold(item[10:14] + ["z"] + item[15:18] + ["z"] + item[19:22])
    assert hold(item[10:15] + ["z"] + item[16:20] + ["z"] + item[21:26])  # two of sixteen
    assert not hold(item[10:16] + item[40:46])
    assert leakage.aligned(item[:6], grams(item[:6]), item[:6])  # a whole, short item


def test_short_items_with_one_word_off_at_every_place():
    for n in (8, 9, 10, 12):
        item = [f"w{i}" for i in range(n)]
        size = leakage.seed_length(n)
        g = {}
        for k in range(n - size + 1):
            g.setdefault(tuple(item[k : k + size]), []).append(k)
        for at in range(n):
            for p in ([*item[:at], "z", *item[at + 1 :]], [*item[:at], *item[at + 1 :]], [*item[:at], "z", *item[at:]]):
                assert leakage.aligned(item, g, ["x"] * 5 + p + ["y"] * 5), (n, at, p)
        assert not leakage.aligned(item, g, ["x"] * 5 + item[1 : n - 1] + ["y"] * 5)


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("kel", "mor", "tan", "vis", "dra") for b in ("lan", "dor", "mir", "sen", "tho", "rin")]
    standing = "Answer the question below in one short line and name your evidence."
    texts = [standing + " " + " ".join(f"{rng.choice(vocab)}{rng.randint(0, 400)} {rng.choice(vocab)}" for _ in range(20)) + "." for _ in range(40)]
    items = spark.createDataFrame([(i, t, [f"sym{i}"]) for i, t in enumerate(texts)] + [(98, None, None), (99, "", [])], "item_id long, text string, expected_symbols array<string>")
    plain = [t[len(standing) + 1 :].split() for t in texts]
    filler = lambda: " ".join(rng.choice(("the", "queue", "waits", "for", "rows", "and", "stops", *vocab)) for _ in range(60))
    docs, want = [], set()
    for i in range(20):
        piece = plain[i][3:17]
        if i % 2:
            piece[6] = "changed"
        docs.append((i, filler() + " " + " ".join(piece).upper() + " " + filler()))
        want.add((i, i))
    docs += [(100, standing + " " + filler()), (101, None), (102, ""), (103, " ".join(plain[5][:8]) + " " + filler()), (104, filler() * 300), (0, docs[0][1])]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {(r["item_id"], r["doc_id"]) for r in got.where("kind = 'passage'").collect()} == want
    assert leakage.leaks(spark.createDataFrame([], "doc_id long, text string"), items).isEmpty()
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).isEmpty()


def test_leaks_in_a_hot_group_and_of_frequent_words(spark):
    rng = random.Random(9)
    own = [" ".join(f"{w}{i}" for w in "oak elm ash fir yew bay fig box gum nut may sal tea".split()) for i in range(12)]
    frequent = "the queue waits for rows and then the worker stops at noon"
    cut_short = "red kite over one quiet north hill tonight"  # eight words, halved by an added one
    items = spark.createDataFrame([(i, t, [f"sym{i}"]) for i, t in enumerate([*own, frequent, cut_short])], "item_id long, text string, expected_symbols array<string>")
    filler = lambda: " ".join(rng.choice("the queue waits for rows and then worker stops at noon".split()) for _ in range(200))
    docs = [(i, f"{own[0]} end{i}") for i in range(120)]  # copies but for the end
    docs += [(i, own[1]) for i in range(200, 320)]  # exact copies
    docs += [(i, filler()) for i in range(400, 440)] + [(500, frequent + " x " + filler()), (501, own[2]), (502, "red kite over one quite quiet north hill tonight"), (503, "red kite over one or quiet north hill tonight")]
    mixed = own[3].split()  # every third word left out, and the answer
    docs += [(i, " ".join(w for k, w in enumerate(mixed) if k % 3) + " sym3") for i in range(600, 720)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    passages = {(r["item_id"], r["doc_id"]) for r in got if r["kind"] == "passage"}
    assert {(0, i) for i in range(120)} | {(1, i) for i in range(200, 320)} | {(12, 500), (2, 501), (13, 503)} <= passages
    assert {(3, i) for i in range(600, 720)} == {(r["item_id"], r["doc_id"]) for r in got if r["kind"] == "paraphrase"}


def test_repeated_items_and_shared_sentences_are_no_standing_instruction(spark):
    standing = "Answer the question below in one short line and name your evidence."
    own = [" ".join(f"{w}{i}" for w in "oak elm ash fir yew bay fig box gum nut may sal tea".split()) + "." for i in range(30)]
    shared = "The worker keeps its lease until the queue is empty and the snapshot of the index is complete."
    rows = [(i, f"{standing} {t} {shared if i < 8 else ''}") for i, t in enumerate(own)]
    rows += [(i, "The red kite turns over one quiet north hill before the rain comes down.") for i in range(100, 120)] + [(130, standing)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [(1, own[3]), (2, rows[30][1]), (3, shared), (4, standing + " " + own[29])]
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, answers=None, block=20).collect()}
    assert got == {(3, 1), (29, 4), (130, 4)} | {(i, 2) for i in range(100, 120)} | {(i, 3) for i in range(8)}


def test_documentation_is_found_from_far_up_and_stays_in_its_repository(spark):
    chain = [(i, 1, f"C{i}.run", i == 12, f"doc {i}" if i == 12 else None, "a") for i in range(13)]
    other = [(50, 2, "C12.stop", True, "other repository", "b"), (51, 1, "C0.stop", False, None, "a")]
    docs = spark.createDataFrame(chain + other, "id long, file_id long, name string, told boolean, documentation string, scope string")
    edges = spark.createDataFrame([(f"C{i}", f"C{i + 1}", "extends", "a") for i in range(12)], "source_name string, target_name string, kind string, scope string")
    got = {r["id"]: r["inherited_from"] for r in docpairs.resolve_inherited(docs, edges).collect()}
    assert got == {i: "C12" for i in range(12)}
    assert docpairs.resolve_inherited(docs.limit(0), edges).isEmpty()


def test_documentation_after_very_long_signatures_and_of_many_symbols(spark):
    text = "def f(\n" + "".join(f"    a{i}: int = {i},\n" for i in range(900)) + "):\n    '''Keeps the answer of every shard.'''\n"
    assert docpairs.doc_in_text(text.split("\n"), 1, "python") == "Keeps the answer of every shard."
    assert "Waits" in docpairs.doc_in_text("# Waits for it.\ndef f".split("\n"), 2, "ruby") and "Waits" in docpairs.doc_in_text("-- Waits.\nCREATE".split("\n"), 2, "sql")
    files = spark.createDataFrame([(1, "a.py", "python")], "id long, path string, language string")
    sources = spark.createDataFrame([("a.py", text)], "path string, text string")
    schema = "id long, file_id long, name string, kind string, start_line int, end_line int, docstring string, signature string"
    rows = spark.createDataFrame([(i, 1, "f", "function", 1, 2, None, None) for i in range(300)], schema)
    assert docpairs.documented(rows, files, sources, per_row=50).where("told").count() == 300


def test_short_squeezed_code_and_long_literals():
    loader = "(()=>{var e={},t={};function r(n){var o=t[n];if(o)return o.exports;var i=t[n]={exports:{}};return e[n](i,i.exports,r),i.exports}r.m=e,r(0)})();"
    assert written.judge("/r/src/l.js", loader)[0] == "compacted"
    assert written.judge("/r/src/k.py", "KEY = (\n" + ("    '" + "QUJD" * 22 + "'\n") * 60 + ")\n")[0] == "data"
    assert written.judge("/r/src/k.py", "def f(a, b):\n    return [x for x in a if x in b and x not in {1, 2, 3}] or sorted(b, key=lambda v: (v, -v))[::2][:10]\n")[0] is None


# ---------------------------------------------------------------- personal information
def found(t):
    return {(t[s:e], k) for s, e, k in pii.find(t)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Reported-by: F. Lorsson <LORSSON_F@FERN.INVALID>", {("F. Lorsson", "name"), ("LORSSON_F@FERN.INVALID", "email")}),
        ("Ask support@fern.example, it is a desk. npm i @kit/a@1.2.3 or git@forge.example:a/b.git, db@localhost:10", set()),
        ("Reach me at m-hall [at] fern.example or +1 816 555 0197 ext. 19 now.", {("m-hall [at] fern.example", "email"), ("+1 816 555 0197", "phone")}),
        ("mail viktor.mardell AT fern DOT test today", {("viktor.mardell AT fern DOT test", "email")}),
        ("Call (837) 555-0168 if it stalls; ticket 2024-190-03583, port pair 189-3933, host 10.2.3.4", {("(837) 555-0168", "phone")}),
        ("telefonisch unter (030) 23125 918. Contactez Wen K. Peldell, appelez le 0033 199 005898.", {("(030) 23125 918", "phone"), ("Wen K. Peldell", "name"), ("0033 199 005898", "phone")}),
        ("noch Steuer-ID 55 742 898 008 von Herr Grisvik.", {("55 742 898 008", "id_number"), ("Grisvik", "name")}),
        ("NINO QQ 84 98 87 D, DNI 00.764.166 A, passport no. X25766756 and 911-81-8902", {("QQ 84 98 87 D", "id_number"), ("00.764.166 A", "id_number"), ("X25766756", "id_number"), ("911-81-8902", "id_number")}),
        ("ships to Ms. van Orstane, Unit 22, 23 Nimley Close, Orfield 06272.", {("van Orstane", "name"), ("Unit 22, 23 Nimley Close, Orfield 06272", "address")}),
        ("geht an Pelhurst, Noor, Dromorestr. 128\n09587 Lorsted. Danke", {("Pelhurst, Noor", "name"), ("Dromorestr. 128\n09587 Lorsted", "address")}),
        ("envoyé à Amara B. Radlano, 42 rue de Drodale, 05970 Kelsted.", {("Amara B. Radlano", "name"), ("42 rue de Drodale, 05970 Kelsted", "address")}),
        ("envía a Lucia Casdell, Avda. de Caswick, 132, 3.º B, 04011 Drosted.", {("Lucia Casdell", "name"), ("Avda. de Caswick, 132, 3.º B, 04011 Drosted", "address")}),
        ("device to P.O. Box 65, Winham 03632 by Friday", {("P.O. Box 65, Winham 03632", "address")}),
        ("Noor TAMTIER wrote: the Merkle Digest column is fine", {("Noor TAMTIER", "name")}),
        ("The hook lives in lane 12, shard street of the map.", set()),
        ("", set()),
    ],
)
def test_find(text, want):
    assert found(text) == want


def test_long_text_and_rows(spark):
    long = "plain words and more of them. " * 20_000 + "cc Ulrike Thalbram"
    df = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (1, long, "y")], "doc_id long, text string, id string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == 2 and long[rows[0]["start_pos"] : rows[0]["end_pos"]] == "Ulrike Thalbram"
    texts = [r["text"] for r in pii.masked(df, b"k").collect()]
    assert sum(t is None for t in texts) == 1 and sum(t == "" for t in texts) == 1 and texts[0].endswith("]") and "[NAME " in texts[0]


def test_pseudonyms_are_permutations_within_the_format():
    key = b"secret"
    for size in (10, 97, 1000):
        assert sorted(pii.feistel(v, size, key) for v in range(size)) == list(range(size))
        assert all(pii.unfeistel(pii.feistel(v, size, key), size, key) == v for v in range(size))
    for v in ("911-81-8902", "QQ 84 98 87 D", "2024-03-09", "+49 (030) 23125 918", "---", ""):
        p = pii.same_format(v, key)
        assert pii.same_format(p, key, back=True) == v and [c.isdigit() for c in p] == [c.isdigit() for c in v]
    bare = lambda v: "".join(c for c in pii.placeholder(v, "phone", key) if c.isdigit())
    assert bare("(837) 555-0168") == bare("837.555.0168") != bare("837.555.0169")
    assert pii.placeholder("A@b.test", "email", key) == pii.placeholder("a (at) b (dot) test", "email", key)
    assert pii.placeholder("Noor Pelhurst", "name", key) == pii.placeholder("Pelhurst, Noor", "name", key)


def test_placeholders_keep_layout_and_checks():
    key = b"secret"
    for v, kind in (("+49 30 1234-567", "phone"), ("0049 30 1234567", "phone"), ("+49 (0)30 1234567", "phone"), ("QQ 84 98 87 D", "id_number"), ("3.12.1987", "date"), ("1987-03-12", "date")):
        p = pii.placeholder(v, kind, key).split(" ", 1)[1][:-1]
        if kind != "date":
            assert [c.isdigit() or c for c in p if not c.isalpha()] == [c.isdigit() or c for c in v if not c.isalpha()] and p != v, v
        assert not v.startswith(("+49", "0049")) or p.startswith(v[:3])
    for v in ("12345678Z", "X1234567L", "123-45-6789", "DE89 3704 0044 0532 0130 00", "1 84 05 75 056 123 40", "86095742719"):
        plain = pii.canonical(v, "id_number")
        assert pii.checked(plain), v
        assert pii.checked(pii.canonical(pii.placeholder(v, "id_number", key).split(" ", 1)[1][:-1], "id_number")) == pii.checked(plain), v
    assert pii.same_date("31/02/1987", key) != "31/02/1987" and pii.same_date("02/31/1987", key)[2] == "/"


def test_names_without_introduction_and_long_values():
    assert found("Yesterday John Smith fixed the parser and Maria Lopez merged it.") == {("John Smith", "name"), ("Maria Lopez", "name")}
    assert found("cc Ulrike Thalbram\nThen Ulrike Thalbram left; see Ulrike Thalbramson and x.Ulrike Thalbram.") == {("Ulrike Thalbram", "name"), ("Ulrike Thalbramson", "name")} - {("Ulrike Thalbramson", "name")}
    local = "very.long." * 30 + "box"
    assert found(f"mail {local}@fern.example now") == {(f"{local}@fern.example", "email")}
    assert found(f"mail {local} (at) fern (dot) example now") == {(f"{local} (at) fern (dot) example", "email")}
    long_name = "Anna-" * 30 + "Maria van der Orstane"
    assert found(f"{long_name} wrote: fine") == {(long_name, "name")}


def test_many_finds_take_no_square_of_time():
    import time

    text = " ".join(f"call +49 30 {i:07d} or a{i}@x{i}.org" for i in range(20_000))
    start = time.time()
    assert len(pii.find(text)) == 40_000 and time.time() - start < 20


def test_masking_needs_a_key(spark):
    with pytest.raises(ValueError):
        pii.masked(spark.createDataFrame([], "doc_id long, text string"), b"")
