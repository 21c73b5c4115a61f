"""Rules of the index as plain JVM-side columns: entry scores, test names, suspects, documents, resources, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import bare_name, normal_key, normal_route

# ---- fixed values: they must be these for equal results ------------------------------------------------------------
#: how much a part of a path speaks for an entry point
PATH_SCORES = {
    "/pages/": 1.8, "/app/api/": 1.8, "/routes/": 1.7, "/controllers/": 1.7, "/handlers/": 1.6, "/views/": 1.6, "views.py": 1.7,
    "urls.py": 1.5, "routes.py": 1.7, "/endpoints/": 1.6, "/api/": 1.5, "/cmd/": 1.6, "/commands/": 1.5, "/cli/": 1.4,
    "main.go": 1.6, "main.py": 1.5, "main.rs": 1.5, "app.py": 1.4, "server.py": 1.4, "/resolvers/": 1.5, "index.ts": 1.3,
}
#: the same for decorators
DECORATOR_SCORES = {
    ".route": 1.8, "@router.": 1.8, "@app.": 1.7, ".command": 1.6, "getmapping": 1.7, "postmapping": 1.7, "requestmapping": 1.7,
    "restcontroller": 1.7, "@controller": 1.6, "@get(": 1.6, "@post(": 1.6, "@api_view": 1.6, "@task": 1.4,
}
#: folders that name no functional area
GENERIC_FOLDERS = ("src", "lib", "app", "pkg", "main", "core", "base")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
#: colours by greatest degree, and that of all larger ones
COLOURS = ((1, "#ff6050"), (3, "#ff8855"), (5, "#ffa060"), (8, "#ffc070"), (12, "#ffe080"), (18, "#fff0c0"), (25, "#fff8e8"), (35, "#e8e8ff"), (50, "#c0d0ff"))
LARGEST = "#80a0ff"
HIGH_BLOCKERS = (
    "incoming_production_edge", "public_api_surface", "route_entrypoint", "operational_config_resource", "inheritance_or_implementation_evidence",
)
CODE_SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "cs", "rb", "c", "cc", "cpp", "h", "hpp", "php", "swift")
STATUS_WORDS = {"ready-for-implementation": "ready-for-agent", "ready": "ready-for-agent", "done": "shipped", "complete": "shipped", "completed": "shipped"}
SECRET_LINE = r"(?i)\b(password|passwd|secret|token|api[_-]?key|private[_-]?key)\b\s*[:=]"
# ---------------------------------------------------------------------------------------------------------------------


def _greatest_of(scores: dict[str, float], text: Column) -> Column:
    return F.greatest(F.lit(1.0), *[F.when(text.contains(p), s).otherwise(1.0) for p, s in scores.items()])


def entry_score(path: Column, decorators: Column) -> Column:
    """The largest score that a path or decorators speak for, 1 where nothing does."""
    low = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    text = F.regexp_replace(F.lower(F.array_join(F.coalesce(decorators, F.array().cast("array<string>")), " ")), r"\s+", "")
    return F.greatest(_greatest_of(PATH_SCORES, low), _greatest_of(DECORATOR_SCORES, text))


def is_test_symbol(name: Column) -> Column:
    """By its last part beginning with test, or its first with Test."""
    return bare_name(name).startswith("test") | F.substring_index(name, ".", 1).startswith("Test")


def tested_name(name: Column) -> Column:
    """What a test's own name says it tests: test_foo and testFoo test foo; null for other names."""
    last = bare_name(name)
    snake, camel = F.regexp_extract(last, r"^test_(.+)$", 1), F.regexp_extract(last, r"^test(.+)$", 1)
    return F.when(snake != "", snake).when(camel != "", F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, F.lit(2), F.length(camel))))


def is_package_file(path: Column) -> Column:
    """Files that stand for their folder."""
    return path.rlike(r"(^|/)(__init__\.py|mod\.rs|index\.(ts|tsx|js|jsx|mjs|cjs))$")


def module_folder(path: Column) -> Column:
    """The innermost folder that names an area; null if all are generic or there is none."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.try_element_at(F.filter(folders, lambda x: (x != "") & ~x.isin(*GENERIC_FOLDERS)), F.lit(-1))


def local_route(method: Column, url: Column) -> Column:
    """The route that a literal client call means; null where its host may be somebody else's or it has no path."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    ours = (host == "") | F.translate(host, "[]", "").isin(*LOCAL_HOSTS)
    return F.when(ours & (bare != ""), F.concat(F.lit("ROUTE "), F.upper(method), F.lit(" "), normal_route(bare)))


def resource_of_key(key: Column) -> Column:
    """struct(category, name) of the resource that a configuration key stands for; null if for none."""
    k = normal_key(key)
    as_ = lambda category, name: F.struct(F.lit(category).alias("category"), name.alias("name"))
    return (
        F.when(k.contains("DATABASE") | k.isin("DB_URL", "DB_DSN"), as_("database", F.lit("DATABASE")))
        .when(k.contains("REDIS") | k.contains("CACHE"), as_("cache", F.when(k.contains("REDIS"), F.lit("REDIS")).otherwise(k)))
        .when(k.contains("QUEUE"), as_("queue", k))
        .when(k.contains("BUCKET") | k.contains("S3") | k.contains("STORAGE"), as_("storage", k))
        .when(k.endswith("_URL") & (k.contains("API") | k.contains("SERVICE")), as_("external", F.regexp_replace(k, "_URL$", "")))
    )


def clean_heading(c: Column) -> Column:
    """A heading without closing marks and tags."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+#+\s*$", "")), r"<[^>]+>", ""))


def normal_status(c: Column) -> Column:
    """A status in its usual word, cut at the first separator; unknown where nothing is left."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), r"^\.+|\.+$", "")), " ", "-")
    first = F.trim(F.element_at(F.split(plain, r"[;,·|]"), 1))
    known = F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, first), F.when(first != "", first), F.lit("unknown"))


def document_status(text: Column) -> Column:
    """The first status that the first forty lines of a document state; unknown if none does."""
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, 40), lambda x: F.trim(x))
    stated = F.transform(lines, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(?i)^status\s*:\s*[\"']?([^\"'\n]+)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?i)\bstatus\s*:\s*`?([^`.\n]+)", 1), F.lit(""))))
    first = F.try_element_at(F.filter(stated, lambda x: x.isNotNull()), F.lit(1))
    return F.when(first.isNull(), "unknown").otherwise(normal_status(first))


def document_kind(path: Column) -> Column:
    """What kind of document a path tells, the first rule that holds."""
    p = F.lower(path)
    name = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(p.contains("/adr/") | name.startswith("adr-") | name.rlike(r"^\d{3,}[-_]"), "adr").when(p.contains("/prd/") | name.contains("prd"), "prd")
        .when(p.contains("roadmap"), "roadmap").when(p.contains("/tasks/"), "task").when(name.contains("benchmark") | p.contains("/eval/"), "benchmark")
        .when(name == "readme.md", "readme").when(name.contains("architecture"), "architecture").when(name.contains("concept"), "concept")
        .when(name.contains("contract"), "api-contract").otherwise("guide")
    )


def span_kind(token: Column) -> Column:
    """What a code span refers to: route, config, file or symbol, the first shape that fits; null for none."""
    suffixes = "|".join([*CODE_SUFFIXES, "md", "markdown"])
    fit = (F.length(token) > 0) & (F.length(token) <= 160) & ~token.rlike("^https?://")
    return F.when(
        fit,
        F.when(token.rlike(r"^/[A-Za-z0-9_./{}:$*-]+$"), "route").when(token.rlike(r"^[A-Z][A-Z0-9_]{2,}$"), "config")
        .when(token.contains("/") | token.rlike(rf"\.({suffixes})$"), "file")
        .when(token.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$") & (F.length(token) > 2), "symbol"),
    )


def strength(reasons: Column, blockers: Column) -> Column:
    """How strongly reasons, against blockers, speak for an unused symbol or file."""
    n, against = F.size(reasons), F.size(blockers)
    return (
        F.when(F.array_contains(blockers, "no_indexed_symbols") | (n == 0), "weak").when(against >= 2, "weak").when(against == 1, "moderate")
        .when(n >= 2, "strong").otherwise("moderate")
    )


def removal_risk(blockers: Column) -> Column:
    """The risk of removing what has these blockers."""
    return F.when(F.arrays_overlap(blockers, F.array(*map(F.lit, HIGH_BLOCKERS))), "high").when(F.size(blockers) > 0, "medium").otherwise("unknown")


def is_special_file(path: Column) -> Column:
    """Entry points and generated files by convention of path."""
    return F.lower(path).rlike(r"(__init__|conftest|manage|settings)\.py$|(^|/)(migrations|fixtures|scripts|generated|vendor|node_modules)(/|$)")


def colour(degree: Column) -> Column:
    """The display colour of a degree."""
    out = F.when(degree <= COLOURS[0][0], COLOURS[0][1])
    for most, name in COLOURS[1:]:
        out = out.when(degree <= most, name)
    return out.otherwise(LARGEST)


def node_size(kind: Column, degree: Column) -> Column:
    """The display size of a node."""
    return F.when(kind.isin("class", "interface"), 6.0).otherwise(4.0) + F.least(F.log1p(F.greatest(degree, F.lit(0)).cast("double")) * 1.5, F.lit(6.0))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), 1)
    step = lambda h, b: F.pmod(h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619).cast("long"), F.lit(1 << 32).cast("long"))
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), step)


def file_label(c: Column, most: int = 120) -> Column:
    """A label that is safe as part of a file name."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    short = F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, most)
    return F.when(short == "", "output").otherwise(short)


def clamp_depth(c: Column, most: int = 10) -> Column:
    """A depth between 1 and ``most``."""
    return F.greatest(F.lit(1), F.least(c, F.lit(most)))


def serialized_size(*columns: str) -> Column:
    """The length of a row as JSON."""
    return F.length(F.to_json(F.struct(*columns)))


def without_secrets(lines: Column, heading: Column, most_lines: int = 60, most_chars: int = 2400) -> Column:
    """The text of a section for search: its heading and non-empty lines, without lines that look like secrets."""
    kept = F.filter(F.transform(F.slice(lines, 1, most_lines), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(SECRET_LINE))
    return F.substring(F.array_join(F.concat(F.array(heading), kept), "\n"), 1, most_chars)
