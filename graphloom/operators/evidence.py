"""Evidence on the index as a whole: test edges, synthesised edges, resolution of targets, suspects, changes and their tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rules import is_special_file, is_test_symbol, removal_risk, strength, tested_name
from graphloom.functions.text import bare_name, is_test_path, is_test_path_narrow, shared_folders
from graphloom.operators.graph import NO_IMPACT, adjacency, coded, numbered, resolved, sized
from graphloom.operators.search import indexed
from graphloom.session import cut

# ---- fixed values --------------------------------------------------------------------------------------------------
FANOUT = 40
PROVENANCE_RANKS = {"test-call": 4, "test-instantiates": 4, "test-import": 3, "test-name-proximity": 1}
CONFIDENCE_RANKS = {"EXTRACTED": 2, "AMBIGUOUS": 1, "INFERRED": 0}
PRODUCTION_KINDS = ("call", "import", "extends", "implements", "instantiates", "holds", "reads", "writes", "uses", "http_calls", "reads_config", "configures")
#: how sources show a collection whose elements are called, and what is put into one
ITERATED = ((r"(\w+)\s*\.\s*forEach\s*\{\s*(?:\$0|it)\s*\(\s*\)", 1), (r"(\w+)\s*\.\s*forEach\s*\(\s*(?:\w+|\(\w+\))\s*=>\s*(?:\w+|\(\w+\))\s*\(\s*\)", 1), (r"for\s+(\w+)\s+in\s+(?:self\.)?(\w+)\s*:\s*\n[ \t]+\1\s*\(", 2))
APPENDED = r"(\w+)\s*\.\s*(?:append|push|add|insert|addCallback|enqueue)\s*\(\s*([A-Za-z_]\w*)\s*\)"
#: how sources register a named handler for an event, and set one off
REGISTERED = r"\.\s*(?:on|subscribe|addListener|addEventListener|register|watch|listen|addCallback)\s*\(\s*['\"]([A-Za-z_][\w.-]*)['\"]\s*,\s*([A-Za-z_]\w*)\s*\)"
REGISTERED_BY_VERB = r"\.\s*on([A-Z][A-Za-z]*)\s*\(\s*([A-Za-z_]\w*)\s*\)"
SET_OFF = r"\.\s*(?:emit|trigger|notify|dispatch|fire|publish|flush)\s*\(\s*['\"]([A-Za-z_][\w.-]*)['\"]"
# ---------------------------------------------------------------------------------------------------------------------


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))


# ---------------------------------------------------------------------------------------------------------------------
# tests
def test_candidates(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_name, target_name, line, file_id, confidence, provenance) from calls, imports and names of tests.

    Targets are names, plain or qualified, that production files define: EXTRACTED in one file, AMBIGUOUS in several. A test
    that calls what its own test file defines tests nothing by that. An import speaks for the tests of its file whose
    names mention it; a test's own name only for a target of one file, INFERRED.
    """
    rows = indexed(symbols, files)
    named = rows.select("file_id", is_test_path(F.col("path")).alias("t"), F.explode(F.array_compact(F.array("name", "qualified_name"))).alias("name")).distinct()
    in_tests = named.where("t").select("name", "file_id")
    counts = named.where("NOT t").groupBy(F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("n"))
    confidence = F.when(F.col("n") == 1, "EXTRACTED").otherwise("AMBIGUOUS")
    cols = ["source_name", "target_name", "line", "file_id", "confidence", "provenance"]

    parsed = edges.where("synthesized_by IS NULL").join(files.where("path NOT LIKE ':%'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    calls = parsed.where(F.col("kind").isin("call", "instantiates") & is_test_symbol(F.col("source_name")))
    calls = calls.join(in_tests.withColumnRenamed("name", "source_name"), ["source_name", "file_id"], "left_semi")
    calls = calls.join(in_tests.withColumnRenamed("name", "target_name"), ["target_name", "file_id"], "left_anti").join(counts, "target_name")
    exact = calls.select("source_name", "target_name", "line", "file_id", confidence.alias("confidence"), F.concat(F.lit("test-"), F.when(F.col("kind") == "call", "call").otherwise("instantiates")).alias("provenance"))

    tests = rows.where(is_test_symbol(F.col("name"))).select("file_id", F.col("name").alias("source_name")).distinct()
    imports = parsed.where("kind = 'import'").select("file_id", "target_name", "line").distinct().join(counts, "target_name").join(tests, "file_id")
    said = F.regexp_replace(F.lower(bare_name(F.col("source_name"))), "^test", "")
    imports = imports.where(said.contains(F.lower(bare_name(F.col("target_name"))))).select(*cols[:4], confidence.alias("confidence"), F.lit("test-import").alias("provenance"))

    own = rows.where(is_test_path(F.col("path")) & is_test_symbol(F.col("name"))).select(F.col("name").alias("source_name"), tested_name(F.col("name")).alias("target_name"), F.col("start_line").alias("line"), "file_id")
    near = own.join(counts.where("n = 1"), "target_name").select(*cols[:4], F.lit("INFERRED").alias("confidence"), F.lit("test-name-proximity").alias("provenance"))
    return exact.unionByName(imports).unionByName(near)


def test_edges(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """The best candidate of each (source_name, target_name): by provenance, confidence, then the first line and file."""
    order = F.struct((-_rank(F.col("provenance"), PROVENANCE_RANKS)).alias("p"), (-_rank(F.col("confidence"), CONFIDENCE_RANKS)).alias("c"), "line", "file_id", "provenance", "confidence")
    best = test_candidates(symbols, files, edges).groupBy("source_name", "target_name").agg(F.min(order).alias("b"))
    return best.select("source_name", "target_name", "b.line", "b.file_id", "b.confidence", "b.provenance")


# ---------------------------------------------------------------------------------------------------------------------
# synthesis
def override_edges(symbols: DataFrame, edges: DataFrame, cap: int = FANOUT) -> DataFrame:
    """(source_name, target_name, synthesized_by): from a method of a base to the method of that name of a class that extends or
    implements it, for each base's method the first ``cap`` by class; 0 is no cap."""
    links = edges.where("kind IN ('extends', 'implements')").select(F.col("source_name").alias("sub"), F.col("target_name").alias("base")).where("sub <> '' AND base <> ''").distinct()
    methods = symbols.where("kind = 'method' AND name LIKE '%.%'").select(F.substring_index("name", ".", 1).alias("owner"), F.regexp_replace("name", r"^[^.]*\.", "").alias("method")).distinct()
    base = links.join(methods.withColumnRenamed("owner", "base"), "base")
    both = base.join(methods.withColumnRenamed("owner", "sub"), ["sub", "method"])
    if cap:
        both = both.withColumn("r", F.row_number().over(Window.partitionBy("base", "method").orderBy("sub"))).where(F.col("r") <= cap)
    return both.select(F.concat_ws(".", "base", "method").alias("source_name"), F.concat_ws(".", "sub", "method").alias("target_name"), F.lit("interface-override").alias("synthesized_by"))


def _known(symbols: DataFrame) -> DataFrame:
    """(word, target): every name and last part of a name, and the only name it can stand for, or itself."""
    names = symbols.select("name").where("name <> ''")
    words = names.select(F.col("name").alias("word"), "name").unionByName(names.where("name LIKE '%.%'").select(bare_name(F.col("name")).alias("word"), "name"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("one")).select("word", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("word")).alias("target"))


def _found(sources: DataFrame, pattern: str, *groups: int) -> DataFrame:
    """The groups of all finds of a pattern in the texts, as columns a, b, ..., each combination once."""
    spans = [F.regexp_extract_all("text", F.lit(pattern), g) for g in groups]
    zipped = F.arrays_zip(*[s.alias(n) for s, n in zip(spans, "ab", strict=False)])
    return sources.select(F.explode(zipped).alias("z")).select("z.*").distinct()


def collection_edges(symbols: DataFrame, sources: DataFrame, cap: int = FANOUT) -> DataFrame:
    """(source_name, target_name, synthesized_by): from a collection whose elements are called somewhere to the named functions
    that are put into it anywhere, the first ``cap`` by name."""
    fields = reduce(DataFrame.union, [_found(sources, p, g) for p, g in ITERATED]).select(F.col("a").alias("field")).distinct()
    put = _found(sources, APPENDED, 1, 2).select(F.col("a").alias("field"), F.col("b").alias("word"))
    hits = put.join(fields, "field", "left_semi").join(_known(symbols), "word")
    if cap:
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("word"))).where(F.col("r") <= cap)
    return hits.select(F.col("field").alias("source_name"), F.col("target").alias("target_name"), F.lit("closure-collection").alias("synthesized_by"))


def event_edges(symbols: DataFrame, sources: DataFrame, cap: int = FANOUT) -> DataFrame:
    """(source_name, target_name, synthesized_by): from an event that is set off somewhere to its registered handlers; events
    of more than ``cap`` handlers give none."""
    taken = _found(sources, REGISTERED, 1, 2).union(_found(sources, REGISTERED_BY_VERB, 1, 2)).select(F.col("a").alias("event"), F.col("b").alias("word")).distinct()
    hits = taken.join(_found(sources, SET_OFF, 1).select(F.col("a").alias("event")), "event", "left_semi").join(_known(symbols), "word")
    if cap:
        few = hits.groupBy("event").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap)
        hits = hits.join(few.select("event"), "event", "left_semi")
    return hits.select(F.col("event").alias("source_name"), F.col("target").alias("target_name"), F.lit("event-emitter").alias("synthesized_by"))


#: the channels of synthesis; each stands for itself
CHANNELS = {
    "interface-override": lambda symbols, edges, sources, cap: override_edges(symbols, edges, cap),
    "closure-collection": lambda symbols, edges, sources, cap: collection_edges(symbols, sources, cap),
    "event-emitter": lambda symbols, edges, sources, cap: event_edges(symbols, sources, cap),
}


def synthesised(symbols: DataFrame, edges: DataFrame, sources: DataFrame, cap: int = FANOUT) -> DataFrame:
    """The call edges of all channels, INFERRED, on line 0."""
    rows = reduce(DataFrame.unionByName, [f(symbols, edges, sources, cap) for f in CHANNELS.values()])
    return rows.distinct().select("source_name", "target_name", F.lit("call").alias("kind"), F.lit(0).alias("line"), F.lit("INFERRED").alias("confidence"), "synthesized_by")


# ---------------------------------------------------------------------------------------------------------------------
# resolution
IMPORT_PATTERNS = (
    # from a.b import c as d, e      group 1 the module, group 2 the names
    ("python", r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+\(?([^)\n#]+)", False),
    ("python", r"(?m)^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?", True),
    ("script", r"import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]", False),
    ("script", r"import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s*from\s*['\"]([^'\"]+)['\"]", True),
    ("script", r"import\s+\*\s*as\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]", True),
)


def import_bindings(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, path, local_name, exported_name, source_module, is_default, is_namespace): what Python and JavaScript or TypeScript
    files bind by imports; a relative module keeps its dots."""
    f = files.select(F.col("id").alias("file_id"), "path", F.when(F.col("language") == "python", "python").when(F.col("language").isin("javascript", "typescript"), "script").alias("family")).where("family IS NOT NULL")
    texts = f.join(sources.where("text IS NOT NULL").select("path", "text"), "path")
    out = []
    for n, (family, pattern, single) in enumerate(IMPORT_PATTERNS):
        pair = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("a"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("b"))
        rows = texts.where(F.col("family") == family).select("file_id", "path", F.explode(pair).alias("z")).select("file_id", "path", "z.a", "z.b")
        if not single:
            module, names = ("a", "b") if family == "python" else ("b", "a")
            rows = rows.select("file_id", "path", F.col(module).alias("source_module"), F.explode(F.split(F.col(names), ",")).alias("one"))
            exported = F.regexp_extract("one", r"^\s*(?:type\s+)?([\w*]+)", 1)
            local = F.coalesce(F.nullif(F.regexp_extract("one", r"\bas\s+(\w+)", 1), F.lit("")), exported)
            rows = rows.select("file_id", "path", local.alias("local_name"), exported.alias("exported_name"), "source_module", F.lit(False).alias("is_default"), F.lit(False).alias("is_namespace"))
        elif family == "python":
            last = F.element_at(F.split("a", r"\."), -1)
            rows = rows.select("file_id", "path", F.coalesce(F.nullif("b", F.lit("")), last).alias("local_name"), last.alias("exported_name"), F.col("a").alias("source_module"), F.lit(False).alias("is_default"), F.lit(True).alias("is_namespace"))
        else:
            rows = rows.select("file_id", "path", F.col("a").alias("local_name"), F.when(F.lit(n == 4), "*").otherwise("default").alias("exported_name"), F.col("b").alias("source_module"), F.lit(n == 3).alias("is_default"), F.lit(n == 4).alias("is_namespace"))
        out.append(rows)
    return reduce(DataFrame.unionByName, out).where("local_name <> '' AND source_module <> ''").distinct()


def binding_paths(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """The bindings with ``target_path``: each file of the index that their module can mean.

    A module is looked for below every folder above the importing file (Python) or relative to it (scripts); as a
    file or as a folder's own file. The candidates are an equality with the files' paths.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    dots = F.length(F.regexp_extract("source_module", r"^(\.*)", 1))
    parts = F.split(folder, "/")
    dotted = F.regexp_replace(F.regexp_replace("source_module", r"^\.+", ""), r"\.", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = F.when(dots > 0, F.array(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(1))), "/"))).otherwise(ups)
    python = F.flatten(F.transform(above, lambda x: F.array(F.concat(x, F.lit("/"), dotted, F.lit(".py")), F.concat(x, F.lit("/"), dotted, F.lit("/__init__.py")))))
    steps = F.length(F.regexp_replace(F.regexp_extract("source_module", r"^((?:\.\./)*)", 1), r"[^/]", ""))
    base = F.concat_ws("/", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - steps, F.lit(1))), "/"), F.regexp_replace("source_module", r"^(\./|\.\./)+", ""))
    script = F.when(F.col("source_module").startswith("."), F.array(base, *[F.concat(base, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")])).otherwise(F.array().cast("array<string>"))
    candidates = F.when(F.col("path").endswith(".py"), python).otherwise(script)
    placed = bindings.select("*", F.explode(F.array_distinct(candidates)).alias("target_path"))
    return placed.join(files.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi")


def resolve_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, target_name, confidence, resolved_by, best_candidate) of each name that a file refers to.

    A name that the file imports from the one file that defines it is EXTRACTED by ``import``. Else the number of definitions
    in the index decides, ``name-count``: one EXTRACTED, several AMBIGUOUS, with the path that shares most folders with
    the referring file, the first of equals, as ``best_candidate``; none is INFERRED, ``unresolved``.
    """
    f = files.select(F.col("id").alias("file_id"), "path")
    asked = edges.where("target_name IS NOT NULL").select("file_id", "target_name").distinct().join(f, "file_id")
    defined = symbols.where("name IS NOT NULL").join(f, "file_id").select("name", "path").distinct()
    bound = binding_paths(import_bindings(files, sources), files).select("file_id", "local_name", "exported_name", "target_path").distinct()
    hits = bound.join(defined.select(F.col("name").alias("exported_name"), F.col("path").alias("target_path")), ["exported_name", "target_path"])
    single = hits.groupBy("file_id", F.col("local_name").alias("target_name")).agg(F.countDistinct("target_path").alias("n"), F.min("target_path").alias("imported")).where("n = 1").drop("n")
    counts = symbols.groupBy(F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("n"))
    # nearest definition: by folders, not by edges; only names with several definitions have one
    several = defined.withColumnRenamed("name", "target_name").join(counts.where("n > 1").select("target_name"), "target_name", "left_semi")
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    near = asked.select("target_name", folder("path").alias("here")).distinct()
    there = several.groupBy("target_name", folder("path").alias("there")).agg(F.min("path").alias("first"))
    score = shared_folders(F.concat("here", F.lit("/x")), F.concat("there", F.lit("/x")))
    best = near.join(there, "target_name").groupBy("target_name", "here").agg(F.min(F.struct((-score).alias("s"), "first"))["first"].alias("best_candidate"))
    rows = asked.withColumn("here", folder("path")).join(counts, "target_name", "left").join(single, ["file_id", "target_name"], "left").join(best, ["target_name", "here"], "left")
    by_import = F.col("imported").isNotNull()
    confidence = F.when(by_import | (F.col("n") == 1), "EXTRACTED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("INFERRED")
    by = F.when(by_import, "import").when(F.col("n") >= 1, "name-count").otherwise("unresolved")
    return rows.select("file_id", "target_name", confidence.alias("confidence"), by.alias("resolved_by"), F.when(by_import, F.col("imported")).otherwise(F.col("best_candidate")).alias("best_candidate"))


# ---------------------------------------------------------------------------------------------------------------------
# suspects
def _present(*pairs: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs])))


def symbol_suspects(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, path, line, reasons, blockers, suspect_strength, removal_risk, uncertain) of every symbol: what the absence of
    edges says for, and their presence against, its being unused. Edges are counted by name before symbols are joined."""
    e = edges.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    test = is_test_path_narrow(F.col("path"))
    unsure = F.col("confidence").isin("INFERRED", "AMBIGUOUS")
    any_ = lambda c, name: F.max(F.coalesce(c, F.lit(False))).alias(name)
    common = lambda p: [
        any_(F.col("kind").isin("reads", "writes"), f"{p}_field"), any_(F.col("kind").isin("extends", "implements", "instantiates"), f"{p}_kin"),
        any_(F.col("kind").isin("reads_config", "configures"), f"{p}_config"), any_(F.col("kind") == "http_calls", f"{p}_route"), any_(unsure, f"{p}_unsure"), F.lit(True).alias(f"{p}_any"),
    ]
    into = e.groupBy(F.col("target_name").alias("name")).agg(
        any_(F.col("kind").isin(*PRODUCTION_KINDS) & ~test, "used"), any_(F.col("kind") == "import", "imported"), any_((F.col("kind") == "tests") | test, "tested"), *common("i")
    )
    out = e.groupBy(F.col("source_name").alias("name")).agg(*common("o"))
    rows = indexed(symbols, files).join(into, "name", "left").join(out, "name", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    either = lambda c: is_(f"i_{c}") | is_(f"o_{c}")
    reasons = _present(
        (~is_("used"), "no_incoming_production_edges"), (~is_("imported"), "no_incoming_imports"), (~is_("tested"), "no_static_test_evidence"),
        (F.coalesce(F.col("visibility").isin("private", "internal"), F.lit(False)) | F.coalesce(~F.col("is_exported"), F.lit(False)), "private_or_internal"), (~either("any"), "isolated_static_graph_node"),
    )
    blockers = _present(
        (is_("used"), "incoming_production_edge"), (is_("tested"), "static_test_evidence"),
        (F.coalesce(F.col("visibility") == "public", F.lit(False)) | F.coalesce(F.col("is_exported"), F.lit(False)), "public_api_surface"),
        ((F.col("kind") == "route") | F.col("name").startswith("ROUTE ") | either("route"), "route_entrypoint"),
        (F.col("kind").isin("config", "resource") | either("config"), "operational_config_resource"), ((F.col("kind") == "field") & either("field"), "field_access_evidence"),
        (F.col("kind").isin("class", "interface", "type") & either("kin"), "inheritance_or_implementation_evidence"), (is_special_file(F.col("path")), "special_file_convention"),
    )
    return rows.select(
        "id", "name", "path", F.col("start_line").alias("line"), reasons.alias("reasons"), blockers.alias("blockers"), either("unsure").alias("uncertain")
    ).select("*", strength(F.col("reasons"), F.col("blockers")).alias("suspect_strength"), removal_risk(F.col("blockers")).alias("removal_risk"))


def file_suspects(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, reasons, blockers, suspect_strength, removal_risk, ambiguous) of every file: whether other files import or
    use what only it defines. Uses of names that several files define are counted as ambiguous, not against it."""
    f = files.where("path NOT LIKE ':%'").select(F.col("id").alias("file_id"), "path")
    defined = symbols.where("name IS NOT NULL").join(f, "file_id").select("name", "file_id").distinct()
    owners = defined.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    e = edges.join(files.select(F.col("id").alias("from_file"), F.col("path").alias("from_path")), edges["file_id"] == F.col("from_file"))
    uses = e.where(F.col("kind").isin(*PRODUCTION_KINDS) & ~is_test_path_narrow(F.col("from_path"))).groupBy(F.col("target_name").alias("name"), "from_file").agg(F.max(F.col("kind") == "import").alias("import"), F.max(F.col("kind") != "import").alias("other"))
    # per name first: a file only asks whether any other file uses the name
    per = uses.groupBy("name").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("import", "other")])
    self_ = uses.select("name", F.col("from_file").alias("file_id"), F.col("import").cast("long").alias("own_import"), F.col("other").cast("long").alias("own_other"))
    rows = defined.join(owners, "name").join(per, "name", "left").join(self_, ["name", "file_id"], "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"own_{c}"), F.lit(0)) > 0
    sums = rows.groupBy("file_id").agg(
        F.max((F.col("n") == 1) & more("import")).alias("imports"), F.max((F.col("n") == 1) & more("other")).alias("usage"), F.max((F.col("n") > 1) & (more("import") | more("other"))).alias("ambiguous")
    )
    out = f.join(sums, "file_id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = _present((~is_("imports"), "file_has_no_incoming_imports"), (~is_("usage"), "contained_symbols_have_no_incoming_production_edges"))
    blockers = _present(
        (is_("imports"), "incoming_import_evidence"), (is_("usage"), "contained_symbol_usage"), (F.col("imports").isNull(), "no_indexed_symbols"),
        (is_test_path_narrow(F.col("path")), "test_file"), (is_special_file(F.col("path")), "special_file_convention"),
    )
    out = out.select("file_id", "path", reasons.alias("reasons"), blockers.alias("blockers"), is_("ambiguous").alias("ambiguous"))
    return out.select("*", strength(F.col("reasons"), F.col("blockers")).alias("suspect_strength"), removal_risk(F.col("blockers")).alias("removal_risk"))


# ---------------------------------------------------------------------------------------------------------------------
# changes
def walk_many(hops: DataFrame, seeds: DataFrame, direction: str = "upstream", depth: int = 3) -> DataFrame:
    """(seed, name, distance, rank): ``walk`` for each seed by itself; the state is a row a (seed, name)."""
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    steps = hops.groupBy(F.col(near).alias("name"), F.col(far).alias("to")).agg(F.max("rank").alias("hop"))
    seen = cut(seeds.select(F.col("name").alias("seed"), "name").where("name IS NOT NULL").distinct().select("seed", "name", F.lit(0).alias("distance"), F.lit(2).alias("rank")))
    frontier, _ = sized(seen)
    for level in range(1, depth + 1):
        reached = steps.join(frontier.select("seed", "name", "rank"), "name").groupBy("seed", F.col("to").alias("name")).agg(F.max(F.least("rank", "hop")).alias("rank"))
        fresh = cut(reached.join(seen.select("seed", "name"), ["seed", "name"], "left_anti").select("seed", "name", F.lit(level).alias("distance"), "rank"))
        frontier, n = sized(fresh)
        if not n:
            break
        seen = seen.unionByName(fresh)
    return seen.where("distance > 0")


def reached_by_others(adj: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(name): names that lead to a seed other than themselves within ``depth`` hops: the names of ``walk_many``, upstream.

    Of the seeds that a name leads to only the first and the last by name are kept: one of them is another than the name
    itself if any is. So the state is a row a name, not a row a (seed, name).
    """
    links = adj.select("src", "dst").where("src <> dst")
    seeds = seeds.select("name").where("name IS NOT NULL").distinct()
    # other names neither lead on nor are looked for
    ids = numbered(links.select(F.col("src").alias("name")).union(seeds).distinct(), "name", "id").select("name", F.col("id").cast("int").alias("id"))
    steps = cut(coded(links, ids).distinct())
    state = cut(ids.join(seeds, "name", "left_semi").select("id", F.col("id").alias("lo"), F.col("id").alias("hi")))
    for _ in range(depth):
        further = steps.join(state.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "lo", "hi")
        state = cut(further.unionByName(state).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return ids.join(state.where("lo <> id OR hi <> id"), "id", "left_semi").select("name")


def changed_symbols(lines: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name): the symbols that changed lines, given as (path, is_new, line), stand in; every symbol of a new file; and a
    null name for a file of which some line stands in none (its own code, or one that the index does not know)."""
    f = files.select(F.col("id").alias("file_id"), "path")
    spans = symbols.where("name IS NOT NULL").join(f, "file_id").select("path", "name", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    known = lines.select("path", "line", F.coalesce("is_new", F.lit(False)).alias("is_new")).where("path IS NOT NULL").distinct()
    old = known.where("NOT is_new").select("path", "line")
    # spans are cut into blocks of 64 lines, so that a line meets only the symbols near it
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / 64), F.floor(F.greatest("end_line", "start_line") / 64))))
    inside = old.withColumn("block", F.floor(F.col("line") / 64)).join(blocks, ["path", "block"]).where("line BETWEEN start_line AND end_line").select("path", "line", "name").distinct()
    bare = old.join(inside.select("path", "line").distinct(), ["path", "line"], "left_anti").select("path", F.lit(None).cast("string").alias("name"))
    new = known.where("is_new").select("path").distinct().join(spans.select("path", "name").distinct(), "path", "left")
    return inside.select("path", "name").unionByName(bare).unionByName(new).distinct()


def change_impact(lines: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(name, distance, rank, tier) of what depends on changed symbols, at the least distance over them all."""
    seeds = changed_symbols(lines, symbols, files).where("name IS NOT NULL").select("name").distinct()
    reached = walk_many(resolved(adjacency(edges, NO_IMPACT), symbols), seeds, "upstream", depth)
    best = reached.groupBy("name").agg(F.min(F.struct("distance", (-F.col("rank")).alias("r"))).alias("b"))
    tier = F.when(F.col("b.distance") <= 1, "will_break").when(F.col("b.distance") == 2, "likely_affected").otherwise("may_need_testing")
    return best.select("name", "b.distance", (-F.col("b.r")).alias("rank"), tier.alias("tier"))


def change_risk(affected: DataFrame) -> DataFrame:
    """One row (affected, will_break, likely_affected, may_need_testing, risk): the severest tier; where all that is affected is
    ambiguous the risk is medium at most."""
    n = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    row = affected.agg(F.count(F.lit(1)).alias("affected"), n("will_break"), n("likely_affected"), n("may_need_testing"), F.coalesce(F.max("rank"), F.lit(0)).alias("best"))
    risk = F.when(F.col("affected") == 0, "low").when((F.col("will_break") > 0) & (F.col("best") > 0), "high").when((F.col("will_break") > 0) | (F.col("likely_affected") > 0), "medium").otherwise("low")
    return row.select("affected", "will_break", "likely_affected", "may_need_testing", risk.alias("risk"))


def affected_tests(changed: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(path, direct, dependents): test files that changed, and those that define what depends on symbols of changed files,
    with how many such names each has. ``changed`` is (path)."""
    f = files.select(F.col("id").alias("file_id"), "path")
    paths = changed.select("path").where("path IS NOT NULL").distinct()
    seeds = symbols.where("name IS NOT NULL").join(f.join(paths, "path", "left_semi"), "file_id", "left_semi").select("name").distinct()
    reached = reached_by_others(edges.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst")), seeds, depth)
    found = symbols.join(reached, "name", "left_semi").join(f, "file_id").where(is_test_path(F.col("path"))).groupBy("path").agg(F.countDistinct("name").alias("dependents"))
    direct = paths.where(is_test_path(F.col("path"))).withColumn("direct", F.lit(True))
    return found.join(direct, "path", "full").select("path", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("dependents", F.lit(0)).alias("dependents"))
