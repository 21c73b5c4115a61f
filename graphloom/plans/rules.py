"""Queries of the scalar rules, each against its own SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rules as R
from graphloom.functions import text as T
from graphloom.plans import query
from graphloom.session import table


def _values(pairs: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in pairs.items()) + ") v(p, s)"


@query("fn_entry_score", f"""SELECT s.id, greatest(1.0, coalesce((SELECT max(v.s) FROM {_values(R.PATH_SCORES)} WHERE contains(lower(replace(f.path, chr(92), '/')), v.p)), 1.0),
  coalesce((SELECT max(v.s) FROM {_values(R.DECORATOR_SCORES)} WHERE contains(regexp_replace(lower(array_to_string(coalesce(s.decorators, []), ' ')), '\\s+', '', 'g'), v.p)), 1.0))::DOUBLE AS score FROM symbols s JOIN files f ON f.id = s.file_id""")
def entry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much path and decorators speak for an entry point."""
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path")
    return table(spark, sf_dir, "symbols").join(f, "file_id").select("id", R.entry_score(F.col("path"), F.col("decorators")).alias("score"))


_L = "list_last(string_split(n, '.'))"


@query("fn_test_names", f"""SELECT DISTINCT n, starts_with({_L}, 'test') OR starts_with(split_part(n, '.', 1), 'Test') AS is_test, CASE WHEN starts_with({_L}, 'test_') AND length({_L}) > 5 THEN substr({_L}, 6) WHEN starts_with({_L}, 'test') AND length({_L}) > 4 THEN lower(substr({_L}, 5, 1)) || substr({_L}, 6) END AS tested
 FROM (SELECT name AS n FROM symbols UNION SELECT 'test_' || name FROM symbols UNION SELECT 'TestCase.test' || upper(left(name, 1)) || substr(name, 2) FROM symbols) WHERE n IS NOT NULL""")
def test_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are tests', and what they test; for every name also with a test made of it."""
    s = table(spark, sf_dir, "symbols").where("name IS NOT NULL")
    upper = F.concat(F.lit("TestCase.test"), F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    n = s.select(F.explode(F.array(F.col("name"), F.concat(F.lit("test_"), "name"), upper)).alias("n")).distinct()
    return n.select("n", R.is_test_symbol(F.col("n")).alias("is_test"), R.tested_name(F.col("n")).alias("tested"))


@query("fn_module_folder", "SELECT id, CASE WHEN path IS NOT NULL THEN list_last(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda x: x <> '' AND x NOT IN ('src', 'lib', 'app', 'pkg', 'main', 'core', 'base'))) END AS folder, regexp_matches(path, '(^|/)(__init__\\.py|mod\\.rs|index\\.(ts|tsx|js|jsx|mjs|cjs))$') AS is_package FROM files")
def module_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that names a file's area, and whether it stands for its folder."""
    return table(spark, sf_dir, "files").select("id", R.module_folder(F.col("path")).alias("folder"), R.is_package_file(F.col("path")).alias("is_package"))


_KEY = "upper(regexp_replace(regexp_replace(trim(k), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query("fn_resource_of_key", f"""WITH a AS (SELECT DISTINCT {_KEY} AS k FROM (SELECT target_name AS k FROM edges WHERE kind = 'reads_config' UNION SELECT 'app-' || name || '.cache' FROM symbols UNION SELECT name || '_api_url' FROM symbols UNION SELECT 'queue ' || name FROM symbols) WHERE k IS NOT NULL)
 SELECT k, CASE WHEN contains(k, 'DATABASE') OR k IN ('DB_URL', 'DB_DSN') THEN 'database' WHEN contains(k, 'REDIS') OR contains(k, 'CACHE') THEN 'cache' WHEN contains(k, 'QUEUE') THEN 'queue' WHEN contains(k, 'BUCKET') OR contains(k, 'S3') OR contains(k, 'STORAGE') THEN 'storage' WHEN ends_with(k, '_URL') AND (contains(k, 'API') OR contains(k, 'SERVICE')) THEN 'external' END AS category,
  CASE WHEN contains(k, 'DATABASE') OR k IN ('DB_URL', 'DB_DSN') THEN 'DATABASE' WHEN contains(k, 'REDIS') THEN 'REDIS' WHEN contains(k, 'CACHE') OR contains(k, 'QUEUE') OR contains(k, 'BUCKET') OR contains(k, 'S3') OR contains(k, 'STORAGE') THEN k WHEN ends_with(k, '_URL') AND (contains(k, 'API') OR contains(k, 'SERVICE')) THEN regexp_replace(k, '_URL$', '') END AS name FROM a""")
def resource_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resource that configuration keys stand for: those that are read, and keys made of all names."""
    e = table(spark, sf_dir, "edges").where("kind = 'reads_config'").select(F.col("target_name").alias("k"))
    s = table(spark, sf_dir, "symbols").select(F.explode(F.array(F.concat(F.lit("app-"), "name", F.lit(".cache")), F.concat("name", F.lit("_api_url")), F.concat(F.lit("queue "), "name"))).alias("k"))
    k = e.union(s).where("k IS NOT NULL").select(T.normal_key(F.col("k")).alias("k")).distinct()
    return k.withColumn("r", R.resource_of_key(F.col("k"))).select("k", "r.category", "r.name")


@query("fn_document_status", r"""WITH l AS (SELECT doc_id, content, line FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS content, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line FROM documents WHERE text IS NOT NULL) WHERE line <= 40),
 f AS (SELECT doc_id, arg_min(coalesce(nullif(regexp_extract(trim(content), '(?i)^status\s*:\s*["'']?([^"''\n]+)', 1), ''), nullif(regexp_extract(trim(content), '(?i)\bstatus\s*:\s*`?([^`.\n]+)', 1), '')), line) AS s FROM l WHERE regexp_matches(trim(content), '(?i)^status\s*:\s*["'']?[^"''\n]') OR regexp_matches(trim(content), '(?i)\bstatus\s*:\s*`?[^`.\n]') GROUP BY doc_id),
 n AS (SELECT doc_id, trim(string_split_regex(replace(lower(regexp_replace(trim(s), '^\.+|\.+$', '', 'g')), ' ', '-'), '[;,·|]')[1]) AS s FROM f)
 SELECT d.doc_id, CASE n.s WHEN 'ready-for-implementation' THEN 'ready-for-agent' WHEN 'ready' THEN 'ready-for-agent' WHEN 'done' THEN 'shipped' WHEN 'complete' THEN 'shipped' WHEN 'completed' THEN 'shipped' ELSE coalesce(nullif(n.s, ''), 'unknown') END AS status FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that documents state."""
    return table(spark, sf_dir, "documents").select("doc_id", R.document_status(F.col("text")).alias("status"))


@query("fn_document_kind", """WITH p AS (SELECT doc_id, lower('/docs/' || coalesce(doc_kind, '') || '/' || coalesce(replace(title, '/', '-'), 'readme') || '.md') AS p FROM documents), n AS (SELECT *, list_last(string_split(p, '/')) AS n FROM p)
 SELECT doc_id, CASE WHEN contains(p, '/adr/') OR starts_with(n, 'adr-') OR regexp_matches(n, '^\\d{3,}[-_]') THEN 'adr' WHEN contains(p, '/prd/') OR contains(n, 'prd') THEN 'prd' WHEN contains(p, 'roadmap') THEN 'roadmap' WHEN contains(p, '/tasks/') THEN 'task' WHEN contains(n, 'benchmark') OR contains(p, '/eval/') THEN 'benchmark'
  WHEN n = 'readme.md' THEN 'readme' WHEN contains(n, 'architecture') THEN 'architecture' WHEN contains(n, 'concept') THEN 'concept' WHEN contains(n, 'contract') THEN 'api-contract' ELSE 'guide' END AS kind FROM n""")
def document_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of document a path tells, for paths made of kind and title."""
    path = F.concat(F.lit("/docs/"), F.coalesce("doc_kind", F.lit("")), F.lit("/"), F.coalesce(F.regexp_replace("title", "/", "-"), F.lit("readme")), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", R.document_kind(path).alias("kind"))


@query("fn_suspect_rules", """SELECT candidate_id, CASE WHEN list_contains(b, 'no_indexed_symbols') OR len(r) = 0 OR len(b) >= 2 THEN 'weak' WHEN len(b) = 1 THEN 'moderate' WHEN len(r) >= 2 THEN 'strong' ELSE 'moderate' END AS strength,
 CASE WHEN list_has_any(b, ['incoming_production_edge', 'public_api_surface', 'route_entrypoint', 'operational_config_resource', 'inheritance_or_implementation_evidence']) THEN 'high' WHEN len(b) > 0 THEN 'medium' ELSE 'unknown' END AS risk FROM (SELECT candidate_id, coalesce(reasons, []) AS r, coalesce(blockers, []) AS b FROM suspect_candidates)""")
def suspect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and risk of all candidates by their reasons and blockers."""
    none = F.array().cast("array<string>")
    c = table(spark, sf_dir, "suspect_candidates").select("candidate_id", F.coalesce("reasons", none).alias("r"), F.coalesce("blockers", none).alias("b"))
    return c.select("candidate_id", R.strength(F.col("r"), F.col("b")).alias("strength"), R.removal_risk(F.col("b")).alias("risk"))


@query("fn_display", """WITH d AS (SELECT name, count(*) AS degree FROM (SELECT source_name AS name FROM edges UNION ALL SELECT target_name FROM edges) GROUP BY name)
 SELECT s.id, CASE WHEN d <= 1 THEN '#ff6050' WHEN d <= 3 THEN '#ff8855' WHEN d <= 5 THEN '#ffa060' WHEN d <= 8 THEN '#ffc070' WHEN d <= 12 THEN '#ffe080' WHEN d <= 18 THEN '#fff0c0' WHEN d <= 25 THEN '#fff8e8' WHEN d <= 35 THEN '#e8e8ff' WHEN d <= 50 THEN '#c0d0ff' ELSE '#80a0ff' END AS colour,
  round(CASE WHEN kind IN ('class', 'interface') THEN 6.0 ELSE 4.0 END::DOUBLE + least(ln(1 + d) * 1.5, 6.0), 6) AS size FROM (SELECT s.id, s.kind, coalesce(d.degree, 0) AS d FROM symbols s LEFT JOIN d ON d.name = s.name) s""")
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour and size of all symbols by their degree."""
    e = table(spark, sf_dir, "edges")
    d = e.select(F.col("source_name").alias("name")).union(e.select("target_name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    s = table(spark, sf_dir, "symbols").join(d, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return s.select("id", R.colour(F.col("degree")).alias("colour"), F.round(R.node_size(F.col("kind"), F.col("degree")), 6).alias("size"))


@query("fn_fnv1a", """SELECT DISTINCT name, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(regexp_extract_all(hex(encode(name)), '(..)', 1), lambda x: ('0x' || x)::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash FROM symbols WHERE name IS NOT NULL""")
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash by which nodes are placed."""
    return table(spark, sf_dir, "symbols").where("name IS NOT NULL").select("name", R.fnv1a(F.col("name")).alias("hash")).distinct()


@query("fn_file_label", "SELECT DISTINCT name, CASE WHEN l = '' THEN 'output' ELSE l END AS label FROM (SELECT name, left(regexp_replace(regexp_replace(regexp_replace(name || '/x.y', '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS l FROM symbols WHERE name IS NOT NULL)")
def file_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are safe in file names."""
    return table(spark, sf_dir, "symbols").where("name IS NOT NULL").select("name", R.file_label(F.concat("name", F.lit("/x.y"))).alias("label")).distinct()


@query("fn_serialized_size", """SELECT id, length(json_object('id', id, 'path', path)) AS size FROM files WHERE path IS NOT NULL""")
def serialized_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long rows are as JSON."""
    return table(spark, sf_dir, "files").where("path IS NOT NULL").select("id", R.serialized_size("id", "path").alias("size"))


@query("fn_path_proximity", """SELECT a.id, b.id AS other, len(list_filter(generate_series(1, least(len(string_split(a.path, '/')), len(string_split(b.path, '/'))) - 1), lambda i: string_split(a.path, '/')[1:i] = string_split(b.path, '/')[1:i])) AS shared FROM files a JOIN files b ON b.id = a.id + 1""")
def path_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leading folders each file shares with the next."""
    f = table(spark, sf_dir, "files")
    other = f.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("path").alias("p2"))
    return f.join(other, "id").select("id", "other", T.shared_folders(F.col("path"), F.col("p2")).alias("shared"))


@query("fn_search_text", r"""SELECT id, array_to_string(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(coalesce(name, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS words_of_name FROM symbols WHERE name IS NOT NULL""".replace("list_distinct(", "(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT ", 1).replace("lambda x: x <> '')), ' ')", "lambda x: x <> '') AS l)) GROUP BY w)), ' ')", 1))
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of names, for search."""
    return table(spark, sf_dir, "symbols").where("name IS NOT NULL").select("id", T.search_text(F.col("name"), F.lit(None).cast("string")).alias("words_of_name"))
