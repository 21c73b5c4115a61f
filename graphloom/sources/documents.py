"""Documents as anchors and references, configuration, containers and routes: what a line of text tells, by columns alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rules import CODE_SUFFIXES, clean_heading, local_route, resource_of_key, span_kind, without_secrets
from graphloom.functions.text import normal_key, normal_route, slug, value_category
from graphloom.operators.sync import innermost
from graphloom.sources.ingest import headings, lines

CONFIDENCES = ("EXACT", "HIGH", "MEDIUM", "LOW")


# ---------------------------------------------------------------------------------------------------------------------
# documents
def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, level, title, heading_path, slug, search_text) of Markdown headings.

    A path has the headings above that hold the heading, the outermost first. The text for search is that of the lines up to
    the next heading, bounded, without lines that look like secrets.
    """
    h = headings(docs).withColumn("title", clean_heading(F.col("title")))
    order = Window.partitionBy("doc_id").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("line", "title")), True).over(before) for k in range(1, 6)}
    h = h.withColumns({f"a{k}": c for k, c in last.items()}).withColumn("next", F.lead("line").over(order))
    # a heading of level k is above if no higher one came after it
    holds = [
        F.when((F.col("level") > k) & reduce(lambda a, b: a & b, [F.col(f"a{j}").isNull() | (F.col(f"a{j}.line") < F.col(f"a{k}.line")) for j in range(1, k)], F.lit(True)), F.col(f"a{k}.title"))
        for k in range(1, 6)
    ]
    path = F.array_join(F.concat(F.array_compact(F.array(*holds)), F.array("title")), " > ")
    rows = h.select("doc_id", F.col("line").alias("start_line"), F.col("last_line").alias("end_line"), "level", "title", path.alias("heading_path"), slug(F.col("title")).alias("slug"), "next")
    text = docs.where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("_lines"))
    section = F.slice("_lines", F.col("start_line") + 1, F.greatest(F.coalesce(F.col("next"), F.size("_lines") + 1) - F.col("start_line") - 1, F.lit(0)))
    return rows.join(text, "doc_id").withColumn("search_text", without_secrets(section, F.col("heading_path"))).drop("_lines", "next")


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, line, target_kind, target_value, confidence, provenance), each once a line: relative links to documents and
    files, code spans by their shape, and issue numbers."""
    rows = lines(docs.where("text IS NOT NULL"), "doc_id")
    spans = rows.select("doc_id", "line", F.explode(F.regexp_extract_all("content", F.lit(r"`([^`\n]{1,180})`"), 1)).alias("v"))
    spans = spans.select("doc_id", "line", span_kind(F.col("v")).alias("target_kind"), F.col("v").alias("target_value")).where("target_kind IS NOT NULL")
    spans = spans.withColumn("confidence", F.when(F.col("target_kind") == "symbol", "MEDIUM").otherwise("HIGH")).withColumn("provenance", F.lit("code-span"))
    links = rows.select("doc_id", "line", F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1)).alias("v"))
    links = links.withColumn("v", F.regexp_replace(F.trim(F.regexp_replace("v", r"#.*$", "")), r"^\./", "")).where(~F.col("v").rlike(r"^([a-z]+://|mailto:)") & (F.col("v") != ""))
    kind = F.when(F.col("v").rlike(r"(?i)\.(md|markdown)$"), "doc").when(F.col("v").rlike(rf"(?i)\.({'|'.join(CODE_SUFFIXES)})$"), "file")
    links = links.select("doc_id", "line", kind.alias("target_kind"), F.col("v").alias("target_value"), F.lit("EXACT").alias("confidence"), F.lit("markdown-link").alias("provenance")).where("target_kind IS NOT NULL")
    issues = rows.select("doc_id", "line", F.lit("issue").alias("target_kind"), F.explode(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])#(\d{1,7})(?![A-Za-z0-9_])"), 1)).alias("target_value"))
    issues = issues.withColumn("confidence", F.lit("MEDIUM")).withColumn("provenance", F.lit("issue-shorthand"))
    return spans.unionByName(links).unionByName(issues).distinct()


def resolve_references(refs: DataFrame, docs: DataFrame, symbols: DataFrame, owned_files: DataFrame) -> DataFrame:
    """The references with (resolved_kind, resolved_value): a symbol's own name where exactly one symbol bears it or has it as
    qualified name; a file's path where one of the document's repository ends with the value; routes and configuration
    keys where a symbol of that kind has it, compared in their normal form; documents and issues as they are. What is not
    resolved has nulls and a confidence of LOW."""
    names = symbols.select("name", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("v"), "kind", "id")
    one = names.groupBy("v").agg(F.countDistinct("id").alias("n"), F.min("name").alias("hit")).where("n = 1").select(F.lit("symbol").alias("target_kind"), F.col("v").alias("key"), "hit")
    keyed = lambda kind, key: symbols.where(F.col("kind") == kind).select(F.lit(kind).alias("target_kind"), key.alias("key"), "id", "name").groupBy("target_kind", "key").agg(F.min_by("name", "id").alias("hit"))
    routes = keyed("route", normal_route(F.regexp_replace("name", r"^ROUTE \w+ ", "")))
    configs = keyed("config", normal_key(F.regexp_replace("name", "^CONFIG ", "")))
    plain = one.unionByName(routes).unionByName(configs)
    key = F.when(F.col("target_kind") == "route", normal_route(F.col("target_value"))).when(F.col("target_kind") == "config", normal_key(F.col("target_value"))).otherwise(F.col("target_value"))
    rows = refs.join(docs.select("doc_id", F.col("source").alias("repo_alias")), "doc_id").withColumn("key", key).join(plain, ["target_kind", "key"], "left")
    # a file is named by the end of its path: every end is a key
    parts = F.split("rest", "/")
    ends = owned_files.where("rest IS NOT NULL").select("repo_alias", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    files = ends.groupBy("repo_alias", "key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file_hit")).where("n = 1").drop("n").withColumn("target_kind", F.lit("file"))
    rows = rows.join(files, ["target_kind", "repo_alias", "key"], "left")
    value = F.when(F.col("target_kind").isin("doc", "issue"), F.col("target_value")).when(F.col("target_kind") == "file", F.col("file_hit")).otherwise(F.col("hit"))
    confidence = F.when(value.isNull(), "LOW").otherwise(F.col("confidence"))
    return rows.select("doc_id", "line", "target_kind", "target_value", F.when(value.isNotNull(), F.col("target_kind")).alias("resolved_kind"), value.alias("resolved_value"), confidence.alias("confidence"), "provenance")


def grounding(resolved: DataFrame, marks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, line, heading_path, target_kind, target_value, resolved_value, confidence, doc_kind, place): references with the
    innermost heading they stand under, ranked by confidence, resolution, document and line."""
    spans = marks.select(F.struct("doc_id", "start_line").alias("span"), F.col("doc_id").alias("file_id"), "start_line", F.coalesce("end_line", F.lit(1 << 30)).alias("end_line"))
    refs = resolved.withColumn("rid", F.xxhash64("doc_id", "line", "target_kind", "target_value", "provenance"))
    # an open end reaches to the last reference of its document
    ends = refs.groupBy(F.col("doc_id").alias("file_id")).agg(F.max("line").alias("to"))
    spans = spans.join(ends, "file_id").withColumn("end_line", F.least("end_line", F.greatest("to", "start_line"))).drop("to")
    at = innermost(refs.select(F.col("rid").alias("point"), F.col("doc_id").alias("file_id"), "line"), spans)
    titled = at.select(F.col("point").alias("rid"), F.col("span.doc_id").alias("doc_id"), F.col("span.start_line").alias("start_line")).join(marks.select("doc_id", "start_line", "heading_path"), ["doc_id", "start_line"]).select("rid", "heading_path")
    rows = refs.join(titled, "rid", "left").join(docs.select("doc_id", "doc_kind"), "doc_id").drop("rid")
    return rows.select("doc_id", "line", "heading_path", "target_kind", "target_value", "resolved_value", "confidence", "doc_kind")


def grounding_order() -> list[Column]:
    """The order of references: confidence, resolved first, document, line, value."""
    return [F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence")), F.col("resolved_value").isNull(), F.col("doc_id"), F.col("line"), F.col("target_kind"), F.col("target_value")]


# ---------------------------------------------------------------------------------------------------------------------
# configuration
CONFIG_READS = (
    r"\bos\.getenv\(\s*[\"']([A-Za-z_][A-Za-z0-9_.-]*)[\"']", r"\bos\.environb?\.get\(\s*[\"']([A-Za-z_][A-Za-z0-9_.-]*)[\"']", r"\bos\.environb?\[\s*[\"']([A-Za-z_][A-Za-z0-9_.-]*)[\"']\s*\]",
    r"\bprocess\.env\.([A-Za-z_][A-Za-z0-9_]*)", r"\bprocess\.env\[\s*[\"']([A-Za-z_][A-Za-z0-9_.-]*)[\"']\s*\]", r"\bimport\.meta\.env\.([A-Za-z_][A-Za-z0-9_]*)",
)


def config_reads(texts: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, key, symbol, target): where sources read configuration, in the innermost symbol of the line (null outside of
    all); lines that are comments are left out."""
    rows = lines(texts.where("text IS NOT NULL"), "path").where(~F.col("content").rlike(r"^\s*(#|//|\*|/\*)"))
    found = reduce(DataFrame.union, [rows.select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(p), 1)).alias("key")) for p in CONFIG_READS]).distinct()
    placed = found.join(files.select(F.col("id").alias("file_id"), "path"), "path").withColumn("point", F.struct("file_id", "line", "key"))
    inside = innermost(placed.select("point", "file_id", "line"), symbols.select(F.col("id").alias("span"), "file_id", "start_line", "end_line"))
    named = inside.join(symbols.select(F.col("id").alias("span"), F.col("name").alias("symbol")), "span").select("point", "symbol")
    return placed.join(named, "point", "left").select("file_id", "line", "key", "symbol", F.concat(F.lit("CONFIG "), normal_key(F.col("key"))).alias("target"))


def env_keys(texts: DataFrame) -> DataFrame:
    """(path, line, key, normal_key, value_category, resource) of env templates; the values themselves are not kept."""
    rows = lines(texts.where("text IS NOT NULL"), "path")
    key = F.regexp_extract("content", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*(?:=.*)?$", 1)
    value = F.regexp_extract("content", r"=\s*[\"']?([^\"'\r]*)", 1)
    return rows.where(key != "").select("path", "line", key.alias("key"), normal_key(key).alias("normal_key"), value_category(F.when(F.col("content").contains("="), value)).alias("value_category"), resource_of_key(key).alias("resource"))


def json_keys(texts: DataFrame, depth: int = 6) -> DataFrame:
    """(path, key, value_category, resource) of JSON files: dotted keys of objects down to ``depth``; values are not kept."""
    level = texts.where("text IS NOT NULL").select("path", F.lit("").alias("at"), F.col("text").alias("v"))
    out = []
    for _ in range(depth):
        pairs = level.select("path", "at", F.explode(F.from_json("v", "map<string,string>")).alias("k", "v")).where("k IS NOT NULL")
        pairs = pairs.select("path", F.when(F.col("at") == "", F.col("k")).otherwise(F.concat_ws(".", "at", "k")).alias("at"), "v")
        nested = F.trim(F.coalesce("v", F.lit(""))).startswith("{")
        out.append(pairs.where(~nested).select("path", F.col("at").alias("key"), value_category(F.col("v")).alias("value_category"), resource_of_key(F.col("at")).alias("resource")))
        level = pairs.where(nested)
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------------------------------------------------------------
# containers
def dockerfile(texts: DataFrame) -> DataFrame:
    """(path, line, category, name, stage): base images (unless they name an earlier stage), stages, copies between stages, keys of
    ENV and ARG, and exposed ports, each with the stage it stands in."""
    rows = lines(texts.where("text IS NOT NULL"), "path").withColumn("content", F.trim(F.regexp_replace("content", r"\s#.*$|\r", "")))
    got = lambda p, g=1: F.regexp_extract("content", rf"(?i)^{p}", g)
    image, alias = got(r"FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?"), got(r"FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?", 2)
    order = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("image", image).withColumn("alias", F.when(image != "", F.when(alias != "", F.lower(alias)).otherwise(F.lit("-"))))
    rows = rows.withColumn("stage", F.nullif(F.last("alias", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("-"))).withColumn("known", F.collect_set("alias").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    one = lambda category, name, cond: rows.where(cond).select("path", "line", F.lit(category).alias("category"), name.alias("name"), "stage")
    copied, exposed, keys = got(r"COPY\s+.*--from=(\S+)"), got(r"EXPOSE\s+(.+)$"), got(r"(?:ENV|ARG)\s+(.+)$")
    return reduce(DataFrame.unionByName, [
        one("image", F.col("image"), (F.col("image") != "") & ~F.array_contains("known", F.lower("image"))), one("stage", F.col("alias"), F.col("alias").isNotNull() & (F.col("alias") != "-")),
        one("copy", copied, copied != ""), one("port", F.explode(F.split(F.regexp_replace(exposed, "/(tcp|udp)", ""), r"\s+")), exposed != ""),
        one("config", F.explode(F.transform(F.when(keys.contains("="), F.regexp_extract_all(keys, F.lit(r"([A-Za-z_]\w*)="), 1)).otherwise(F.array(F.regexp_extract(keys, r"^(\w+)", 1))), lambda x: x)), keys != ""),
    ])


def compose(texts: DataFrame) -> DataFrame:
    """(path, line, service, category, name): services of compose files with image, ports, volumes, networks, env files and keys of
    their environment, by indentation."""
    rows = lines(texts.where("text IS NOT NULL"), "path").withColumn("content", F.regexp_replace("content", r"\s+#.*$|^\s*#.*$|\r", "")).where(F.trim("content") != "")
    indent = F.length(F.regexp_extract("content", r"^(\s*)", 1))
    rows = rows.withColumn("indent", indent).withColumn("key", F.regexp_extract("content", r"^\s*([\w.-]+)\s*:", 1)).withColumn("item", F.trim(F.regexp_extract("content", r"^\s*-\s*(.+)$", 1)))
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when((F.col("indent") == 0) & (F.col("key") != ""), F.col("key")), True).over(upto)).where("section = 'services' AND indent > 0")
    depth = F.min("indent").over(Window.partitionBy("path"))
    rows = rows.withColumn("d", depth).withColumn("service", F.last(F.when((F.col("indent") == F.col("d")) & (F.col("key") != ""), F.col("key")), True).over(upto))
    rows = rows.withColumn("prop", F.last(F.when((F.col("indent") > F.col("d")) & (F.col("key") != "") & (F.col("item") == "") & (F.col("indent") <= F.col("d") + 4), F.struct("indent", "key")), True).over(upto))
    value = F.trim(F.regexp_replace(F.regexp_extract("content", r":\s*(.*)$", 1), r"^[\"']|[\"']$", ""))
    plain = F.regexp_replace("item", r"^[\"']|[\"']$", "")
    one = lambda category, name, cond: rows.where(cond & F.col("service").isNotNull()).select("path", "line", "service", F.lit(category).alias("category"), name.alias("name"))
    listed = lambda prop: (F.col("prop.key") == prop) & (F.col("item") != "")
    return reduce(DataFrame.unionByName, [
        one("service", F.col("key"), (F.col("indent") == F.col("d")) & (F.col("key") != "")), one("image", value, (F.col("key") == "image") & (value != "")), one("port", plain, listed("ports")),
        one("volume", F.element_at(F.split(plain, ":"), 1), listed("volumes")), one("network", plain, listed("networks")), one("env_file", F.when(F.col("item") != "", plain).otherwise(value), (listed("env_file") | ((F.col("key") == "env_file") & (value != "")))),
        one("config", F.element_at(F.split(plain, "="), 1), listed("environment")),
    ])


# ---------------------------------------------------------------------------------------------------------------------
# routes
_VERBS = "get|post|put|delete|patch|head|options"
PYTHON_FRAMEWORKS = {"FastAPI": "fastapi", "APIRouter": "fastapi", "Flask": "flask", "Blueprint": "flask"}


def _receivers(texts: DataFrame, pattern: str, frameworks: dict[str, str]) -> DataFrame:
    """(path, receiver, framework): variables that sources show to be a framework's."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("a"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("b"))
    known = F.create_map(*[F.lit(x) for kv in frameworks.items() for x in kv])
    return texts.where("text IS NOT NULL").select("path", F.explode(both).alias("z")).select("path", F.col("z.a").alias("receiver"), F.try_element_at(known, F.col("z.b")).alias("framework")).where("framework IS NOT NULL").distinct()


def python_routes(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, route, method, handler, line, framework): one row a method of each route decorator, on receivers whose file makes
    them of FastAPI or Flask; ``symbols`` has path, name, decorators and start_line."""
    proof = _receivers(texts, r"(?m)^[ \t]*(\w+)\s*=\s*(?:\w+\.)?(FastAPI|APIRouter|Flask|Blueprint)\(", PYTHON_FRAMEWORKS)
    deco = symbols.select("path", F.col("name").alias("handler"), F.col("start_line").alias("line"), F.explode("decorators").alias("d"))
    got = lambda p, g: F.regexp_extract("d", p, g)
    simple = rf"^@?(\w+)\.({_VERBS}|route|api_route)\(\s*[\"']([^\"']+)[\"']"
    deco = deco.withColumn("receiver", got(simple, 1)).withColumn("verb", F.upper(got(simple, 2))).withColumn("raw", got(simple, 3)).where("receiver <> ''")
    listed = F.transform(F.regexp_extract_all(F.regexp_extract("d", r"methods\s*=\s*[\[({]([^\])}]*)", 1), F.lit(r"[\"'](\w+)[\"']"), 1), lambda x: F.upper(x))
    methods = F.when(~F.col("verb").isin("ROUTE", "API_ROUTE"), F.array("verb")).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    rows = deco.join(proof, ["path", "receiver"]).withColumn("method", F.explode(methods))
    return rows.select("path", F.concat(F.lit("ROUTE "), F.col("method"), F.lit(" "), normal_route(F.col("raw"))).alias("route"), "method", "handler", "line", "framework")


def script_routes(texts: DataFrame) -> DataFrame:
    """(path, route, method, handler, line, framework): registrations on receivers that are made by express() or Router()."""
    proof = _receivers(texts, r"(?m)(?:const|let|var)\s+(\w+)\s*=\s*(?:\w+\.)?(express|Router)\(", {"express": "express", "Router": "express"})
    rows = lines(texts.where("text IS NOT NULL"), "path")
    call = rf"\b(\w+)\.({_VERBS})\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*(?:\w+\s*,\s*)*(\w+)\s*\))?"
    got = lambda g: F.regexp_extract("content", call, g)
    hits = rows.select("path", "line", got(1).alias("receiver"), F.upper(got(2)).alias("method"), got(3).alias("raw"), F.nullif(got(4), F.lit("")).alias("handler")).where("receiver <> ''")
    return hits.join(proof, ["path", "receiver"]).select("path", F.concat(F.lit("ROUTE "), F.col("method"), F.lit(" "), normal_route(F.col("raw"))).alias("route"), "method", "handler", "line", "framework")


def http_calls(texts: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, source_name, route): literal client calls (requests, httpx, fetch, axios) from inside a symbol to a route of
    this system; calls to hosts of others are left out."""
    rows = lines(texts.where("text IS NOT NULL"), "path").where(~F.col("content").rlike(r"^\s*(#|//|\*)"))
    client = rf"\b(?:requests|httpx|axios)\.({_VERBS})\(\s*[\"'`]([^\"'`]+)[\"'`]"
    fetch = r"\bfetch\(\s*[\"'`]([^\"'`]+)[\"'`](?:[^)]*method\s*:\s*[\"'](\w+)[\"'])?"
    axios = r"\baxios\(\s*\{[^}]*url\s*:\s*[\"'`]([^\"'`]+)[\"'`]"
    verb = F.regexp_extract("content", r"method\s*:\s*[\"'](\w+)[\"']", 1)
    got = lambda p, g: F.regexp_extract("content", p, g)
    get = lambda c: F.when(c == "", "GET").otherwise(c)
    hits = reduce(DataFrame.union, [
        rows.withColumn("u", got(client, 2)).where("u <> ''").select("path", "line", local_route(got(client, 1), F.col("u")).alias("route")),
        rows.withColumn("u", got(fetch, 1)).where("u <> ''").select("path", "line", local_route(get(got(fetch, 2)), F.col("u")).alias("route")),
        rows.withColumn("u", got(axios, 1)).where("u <> ''").select("path", "line", local_route(get(verb), F.col("u")).alias("route")),
    ]).where("route IS NOT NULL").distinct()
    placed = hits.join(files.select(F.col("id").alias("file_id"), "path"), "path").withColumn("point", F.struct("file_id", "line", "route"))
    inside = innermost(placed.select("point", "file_id", "line"), symbols.select(F.col("id").alias("span"), "file_id", "start_line", "end_line"))
    return inside.join(symbols.select(F.col("id").alias("span"), F.col("name").alias("source_name")), "span").select("point.file_id", "point.line", "source_name", "point.route")


def cross_repository_callers(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(route, caller_repo, source_name, route_repo, derived): callers of routes over all repositories; a call is derived where the
    route is another repository's. ``calls`` has repo, source_name, route; ``routes`` repo, route."""
    left = calls.select(F.col("repo").alias("caller_repo"), "source_name", "route").distinct()
    right = routes.select(F.col("repo").alias("route_repo"), "route").distinct()
    return left.join(right, "route").withColumn("derived", F.col("caller_repo") != F.col("route_repo"))


def shared_keys(keys: DataFrame, least: int = 2) -> DataFrame:
    """(key, repos): configuration keys, in their normal form, that at least so many repositories have; ``keys`` has repo and key."""
    return keys.select("repo", normal_key(F.col("key")).alias("key")).where("key <> ''").groupBy("key").agg(F.countDistinct("repo").alias("repos")).where(F.col("repos") >= least)
