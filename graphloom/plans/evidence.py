"""Queries on tests, synthesis, resolution, suspects and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evidence as E
from graphloom.plans import query
from graphloom.session import table

_IS_TEST = "(list_has_any(list_slice(string_split({p}, '/'), 1, -2), ['test', 'tests']) OR regexp_matches(lower({p}), '(^|/)(conftest|test_[^/]*)\\.py$|_test\\.py$|\\.(spec|test)\\.[jt]sx?$'))"
_NARROW = "(contains('/' || lower({p}), '/test/') OR contains('/' || lower({p}), '/tests/') OR regexp_matches(lower({p}), '_test\\.py$|\\.(test|spec)\\.(ts|js)$'))"
_TEST_NAME = "(starts_with(list_last(string_split({n}, '.')), 'test') OR starts_with(split_part({n}, '.', 1), 'Test'))"
_LAST = "list_last(string_split({n}, '.'))"


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


_TESTS = f"""WITH s AS (SELECT s.*, f.path, {_IS_TEST.format(p='f.path')} AS t FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path NOT LIKE ':%'),
 nm AS (SELECT DISTINCT name, file_id, t FROM (SELECT name, file_id, t FROM s UNION ALL SELECT qualified_name, file_id, t FROM s) WHERE name IS NOT NULL), pc AS (SELECT name, count(*) AS n FROM nm WHERE NOT t GROUP BY name),
 p AS (SELECT e.* FROM edges e JOIN files f ON f.id = e.file_id WHERE f.path NOT LIKE ':%' AND e.synthesized_by IS NULL),
 a AS (SELECT source_name, target_name, line, file_id, CASE WHEN n = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence, 'test-' || kind AS provenance FROM p JOIN pc ON pc.name = target_name
   WHERE kind IN ('call', 'instantiates') AND {_TEST_NAME.format(n='source_name')} AND (source_name, file_id) IN (SELECT (name, file_id) FROM nm WHERE t) AND (target_name, file_id) NOT IN (SELECT (name, file_id) FROM nm WHERE t)),
 b AS (SELECT t.name, p.target_name, p.line, p.file_id, CASE WHEN n = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END, 'test-import' FROM p JOIN pc ON pc.name = p.target_name JOIN (SELECT DISTINCT name, file_id FROM s WHERE {_TEST_NAME.format(n='name')}) t ON t.file_id = p.file_id
   WHERE p.kind = 'import' AND contains(regexp_replace(lower({_LAST.format(n='t.name')}), '^test', ''), lower({_LAST.format(n='p.target_name')}))),
 g AS (SELECT name, start_line, file_id, CASE WHEN starts_with({_LAST.format(n='name')}, 'test_') AND length({_LAST.format(n='name')}) > 5 THEN substr({_LAST.format(n='name')}, 6)
   WHEN starts_with({_LAST.format(n='name')}, 'test') AND length({_LAST.format(n='name')}) > 4 THEN lower(substr({_LAST.format(n='name')}, 5, 1)) || substr({_LAST.format(n='name')}, 6) END AS target FROM s WHERE t AND {_TEST_NAME.format(n='name')}),
 c AS (SELECT g.name, g.target, g.start_line, g.file_id, 'INFERRED', 'test-name-proximity' FROM g JOIN pc ON pc.name = g.target WHERE pc.n = 1),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
 SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source_name, target_name ORDER BY CASE provenance WHEN 'test-call' THEN 4 WHEN 'test-instantiates' THEN 4 WHEN 'test-import' THEN 3 ELSE 1 END DESC,
   CASE confidence WHEN 'EXTRACTED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END DESC, line, file_id, provenance) AS r FROM u) WHERE r = 1"""


@query("ev_test_edges", _TESTS)
def test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test tests what, the best evidence of each pair."""
    return E.test_edges(*_tables(spark, sf_dir, "symbols", "files", "edges"))


_KNOWN = """kn AS (SELECT word, CASE WHEN count(*) = 1 THEN min(name) ELSE word END AS target FROM (SELECT name AS word, name FROM symbols WHERE name <> '' UNION ALL SELECT list_last(string_split(name, '.')), name FROM symbols WHERE name LIKE '%.%') GROUP BY word)"""
_OVERRIDE = """SELECT base || '.' || method AS source_name, sub || '.' || method AS target_name, 'interface-override' AS synthesized_by FROM (SELECT l.base, l.sub, b.method, row_number() OVER (PARTITION BY l.base, b.method ORDER BY l.sub) AS r
 FROM (SELECT DISTINCT source_name AS sub, target_name AS base FROM edges WHERE kind IN ('extends', 'implements') AND source_name <> '' AND target_name <> '') l JOIN m b ON b.owner = l.base JOIN m s ON s.owner = l.sub AND s.method = b.method) WHERE r <= 40"""
_M = "m AS (SELECT DISTINCT split_part(name, '.', 1) AS owner, substr(name, strpos(name, '.') + 1) AS method FROM symbols WHERE kind = 'method' AND name LIKE '%.%')"
_ALL = lambda p, g: f"unnest(regexp_extract_all(text, '{p}', {g}))"
_PUT = r"(\w+)\s*\.\s*(?:append|push|add|insert|addCallback|enqueue)\s*\(\s*([A-Za-z_]\w*)\s*\)"
_COLLECTION = (
    "SELECT DISTINCT field AS source_name, target AS target_name, 'closure-collection' AS synthesized_by FROM (SELECT p.field, kn.target, row_number() OVER (PARTITION BY p.field ORDER BY p.word) AS r FROM (SELECT DISTINCT "
    + _ALL(_PUT, 1) + " AS field, " + _ALL(_PUT, 2) + " AS word FROM file_sources) p JOIN kn ON kn.word = p.word WHERE p.field IN (SELECT "
    + _ALL(r"(\w+)\s*\.\s*forEach\s*\{\s*(?:\$0|it)\s*\(\s*\)", 1) + " FROM file_sources UNION SELECT " + _ALL(r"(\w+)\s*\.\s*forEach\s*\(\s*(?:\w+|\(\w+\))\s*=>\s*(?:\w+|\(\w+\))\s*\(\s*\)", 1)
    + " FROM file_sources UNION SELECT f FROM (SELECT " + _ALL(r"for\s+(\w+)\s+in\s+(?:self\.)?(\w+)\s*:\s*\n[ \t]+(\w+)\s*\(", 1) + " AS v, " + _ALL(r"for\s+(\w+)\s+in\s+(?:self\.)?(\w+)\s*:\s*\n[ \t]+(\w+)\s*\(", 2)
    + " AS f, " + _ALL(r"for\s+(\w+)\s+in\s+(?:self\.)?(\w+)\s*:\s*\n[ \t]+(\w+)\s*\(", 3) + " AS c FROM file_sources) WHERE v = c)) WHERE r <= 40"
)
_Q = "[''\"]"
_REG = r"\.\s*(?:on|subscribe|addListener|addEventListener|register|watch|listen|addCallback)\s*\(\s*" + _Q + r"([A-Za-z_][\w.-]*)" + _Q + r"\s*,\s*([A-Za-z_]\w*)\s*\)"
_VERB = r"\.\s*on([A-Z][A-Za-z]*)\s*\(\s*([A-Za-z_]\w*)\s*\)"
_EVENT = (
    "SELECT DISTINCT event AS source_name, target AS target_name, 'event-emitter' AS synthesized_by FROM (SELECT h.event, kn.target, count(*) OVER (PARTITION BY h.event) AS n FROM (SELECT DISTINCT * FROM (SELECT " + _ALL(_REG, 1) + " AS event, " + _ALL(_REG, 2)
    + " AS word FROM file_sources UNION ALL SELECT " + _ALL(_VERB, 1) + ", " + _ALL(_VERB, 2) + " FROM file_sources)) h JOIN kn ON kn.word = h.word WHERE h.event IN (SELECT "
    + _ALL(r"\.\s*(?:emit|trigger|notify|dispatch|fire|publish|flush)\s*\(\s*" + _Q + r"([A-Za-z_][\w.-]*)" + _Q, 1) + " FROM file_sources)) WHERE n <= 40"
)


@query("ev_synthesised", f"WITH {_KNOWN}, {_M}, o AS ({_OVERRIDE}), c AS ({_COLLECTION}), v AS ({_EVENT}) SELECT source_name, target_name, 'call' AS kind, 0 AS line, 'INFERRED' AS confidence, synthesized_by FROM (SELECT * FROM o UNION SELECT * FROM c UNION SELECT * FROM v)")
def synthesised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges that overrides, collections of functions and events stand for."""
    return E.synthesised(*_tables(spark, sf_dir, "symbols", "edges", "file_sources"))


@query("ev_overrides_by_name", f"""WITH {_M}, f AS (SELECT method, min(owner) AS base FROM m GROUP BY method HAVING count(*) >= 2), l AS (SELECT DISTINCT f.base, m.owner AS sub FROM f JOIN m USING (method) WHERE m.owner <> f.base)
 SELECT base || '.' || method AS source_name, sub || '.' || method AS target_name, 'interface-override' AS synthesized_by FROM (SELECT l.base, l.sub, b.method, row_number() OVER (PARTITION BY l.base, b.method ORDER BY l.sub) AS r FROM l JOIN m b ON b.owner = l.base JOIN m s ON s.owner = l.sub AND s.method = b.method) WHERE r <= 40""")
def overrides_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The override channel on links that are made for it: from every class to the first class with a method of the same name."""
    s = table(spark, sf_dir, "symbols")
    m = s.where("kind = 'method' AND name LIKE '%.%'").select(F.substring_index("name", ".", 1).alias("owner"), F.regexp_replace("name", r"^[^.]*\.", "").alias("method")).distinct()
    base = m.groupBy("method").agg(F.min("owner").alias("target_name"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    links = m.join(base, "method").where("owner <> target_name").select(F.col("owner").alias("source_name"), "target_name", F.lit("extends").alias("kind")).distinct()
    return E.override_edges(s, links)


_BOUND = r"""b AS (SELECT file_id, path, mod, CASE WHEN al <> '' THEN al ELSE ex END AS local_name, ex AS exported_name FROM (SELECT file_id, path, mod, regexp_extract(one, '^\s*(?:type\s+)?([\w*]+)', 1) AS ex, regexp_extract(one, '\bas\s+(\w+)', 1) AS al FROM (
   SELECT file_id, path, mod, unnest(string_split(names, ',')) AS one FROM (SELECT f.id AS file_id, f.path, unnest(regexp_extract_all(text, '(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+\(?([^)\n#]+)', 1)) AS mod, unnest(regexp_extract_all(text, '(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+\(?([^)\n#]+)', 2)) AS names FROM files f JOIN file_sources t ON t.path = f.path WHERE f.language = 'python'
   UNION ALL SELECT f.id, f.path, unnest(regexp_extract_all(text, 'import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*[''"]([^''"]+)[''"]', 2)), unnest(regexp_extract_all(text, 'import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*[''"]([^''"]+)[''"]', 1)) FROM files f JOIN file_sources t ON t.path = f.path WHERE f.language IN ('javascript', 'typescript'))))
  UNION SELECT file_id, path, mod, CASE WHEN al <> '' THEN al ELSE list_last(string_split(mod, '.')) END, list_last(string_split(mod, '.')) FROM (SELECT f.id AS file_id, f.path, unnest(regexp_extract_all(text, '(?m)^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?', 1)) AS mod, unnest(regexp_extract_all(text, '(?m)^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?', 2)) AS al FROM files f JOIN file_sources t ON t.path = f.path WHERE f.language = 'python')
  UNION SELECT f.id, f.path, unnest(regexp_extract_all(text, 'import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s*from\s*[''"]([^''"]+)[''"]', 2)), unnest(regexp_extract_all(text, 'import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s*from\s*[''"]([^''"]+)[''"]', 1)), 'default' FROM files f JOIN file_sources t ON t.path = f.path WHERE f.language IN ('javascript', 'typescript')
  UNION SELECT f.id, f.path, unnest(regexp_extract_all(text, 'import\s+\*\s*as\s+(\w+)\s+from\s*[''"]([^''"]+)[''"]', 2)), unnest(regexp_extract_all(text, 'import\s+\*\s*as\s+(\w+)\s+from\s*[''"]([^''"]+)[''"]', 1)), '*' FROM files f JOIN file_sources t ON t.path = f.path WHERE f.language IN ('javascript', 'typescript'))"""


@query("ev_import_bindings", f"WITH {_BOUND} SELECT DISTINCT file_id, local_name, exported_name, mod AS source_module FROM b WHERE local_name <> '' AND mod <> ''")
def import_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files bind by imports."""
    return E.import_bindings(*_tables(spark, sf_dir, "files", "file_sources")).select("file_id", "local_name", "exported_name", "source_module").distinct()


_DIR = "regexp_replace({p}, '/[^/]*$', '')"


@query("ev_nearest_definition", f"""WITH c AS (SELECT name, count(*) AS n FROM symbols GROUP BY name), d AS (SELECT DISTINCT s.name, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IN (SELECT name FROM c WHERE n > 1)),
 a AS (SELECT DISTINCT e.file_id, e.target_name, f.path FROM edges e JOIN files f ON f.id = e.file_id WHERE e.target_name IS NOT NULL),
 x AS (SELECT a.file_id, a.target_name, d.path AS candidate, len(list_filter(generate_series(1, least(len(string_split(a.path, '/')), len(string_split(d.path, '/'))) - 1), lambda i: string_split(a.path, '/')[1:i] = string_split(d.path, '/')[1:i])) AS score FROM a JOIN d ON d.name = a.target_name),
 b AS (SELECT file_id, target_name, candidate FROM (SELECT *, row_number() OVER (PARTITION BY file_id, target_name ORDER BY score DESC, candidate) AS r FROM x) WHERE r = 1)
 SELECT a.file_id, a.target_name, CASE WHEN c.n = 1 THEN 'EXTRACTED' WHEN c.n > 1 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS confidence, CASE WHEN c.n >= 1 THEN 'name-count' ELSE 'unresolved' END AS resolved_by, b.candidate AS best_candidate FROM a LEFT JOIN c ON c.name = a.target_name LEFT JOIN b ON b.file_id = a.file_id AND b.target_name = a.target_name""")
def nearest_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every name that a file refers to is resolved without imports, with the nearest of several definitions."""
    symbols, edges, files, sources = _tables(spark, sf_dir, "symbols", "edges", "files", "file_sources")
    return E.resolve_edges(edges, symbols, files, sources.limit(0))


@query("ev_resolution", f"""WITH {_BOUND}, d AS (SELECT DISTINCT s.name, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IS NOT NULL),
 up AS (SELECT file_id, path, local_name, exported_name, mod, length(regexp_extract(mod, '^(\\.*)', 1)) AS dots, replace(regexp_replace(mod, '^\\.+', ''), '.', '/') AS rel FROM b WHERE path LIKE '%.py' AND local_name <> ''),
 py AS (SELECT u.file_id, u.local_name, u.exported_name, t.path AS target FROM up u JOIN files t ON list_contains(list_transform(CASE WHEN u.dots > 0 THEN [array_to_string(string_split(u.path, '/')[1:greatest(len(string_split(u.path, '/')) - u.dots, 1)], '/')]
   ELSE list_transform(generate_series(1, len(string_split(u.path, '/')) - 1), lambda i: array_to_string(string_split(u.path, '/')[1:i], '/')) END, lambda x: x || '/' || u.rel || '.py'), t.path) WHERE t.path LIKE '%.py'),
 ts AS (SELECT b.file_id, b.local_name, b.exported_name, t.path AS target FROM b JOIN files t ON b.mod LIKE '.%' AND b.path NOT LIKE '%.py' AND regexp_replace(t.path, '\\.(ts|tsx|js|jsx|mjs)$', '') = array_to_string(string_split(b.path, '/')[1:greatest(len(string_split(b.path, '/')) - 1 - length(regexp_replace(regexp_extract(b.mod, '^((?:\\.\\./)*)', 1), '[^/]', '', 'g')), 1)], '/') || '/' || regexp_replace(b.mod, '^(\\./|\\.\\./)+', '') AND regexp_matches(t.path, '\\.(ts|tsx|js|jsx|mjs)$')),
 h AS (SELECT x.file_id, x.local_name, min(x.target) AS imported FROM (SELECT DISTINCT * FROM py UNION SELECT * FROM ts) x JOIN d ON d.name = x.exported_name AND d.path = x.target GROUP BY x.file_id, x.local_name HAVING count(DISTINCT x.target) = 1)
 SELECT DISTINCT e.file_id, e.target_name, h.imported AS best_candidate FROM edges e JOIN h ON h.file_id = e.file_id AND h.local_name = e.target_name""")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a file imports from the one file that defines them."""
    symbols, edges, files, sources = _tables(spark, sf_dir, "symbols", "edges", "files", "file_sources")
    return E.resolve_edges(edges, symbols, files, sources).where("resolved_by = 'import'").select("file_id", "target_name", "best_candidate")


_KINDS = "('call', 'import', 'extends', 'implements', 'instantiates', 'holds', 'reads', 'writes', 'uses', 'http_calls', 'reads_config', 'configures')"
_SPECIAL = "regexp_matches(lower({p}), '(__init__|conftest|manage|settings)\\.py$|(^|/)(migrations|fixtures|scripts|generated|vendor|node_modules)(/|$)')"
_FLAGS = "bool_or(kind IN ('reads', 'writes')) AS field, bool_or(kind IN ('extends', 'implements', 'instantiates')) AS kin, bool_or(kind IN ('reads_config', 'configures')) AS config, bool_or(kind = 'http_calls') AS route, coalesce(bool_or(confidence IN ('INFERRED', 'AMBIGUOUS')), false) AS unsure"
_RANKED = """SELECT *, CASE WHEN list_contains(blockers, 'no_indexed_symbols') OR len(reasons) = 0 OR len(blockers) >= 2 THEN 'weak' WHEN len(blockers) = 1 THEN 'moderate' WHEN len(reasons) >= 2 THEN 'strong' ELSE 'moderate' END AS suspect_strength,
 CASE WHEN list_has_any(blockers, ['incoming_production_edge', 'public_api_surface', 'route_entrypoint', 'operational_config_resource', 'inheritance_or_implementation_evidence']) THEN 'high' WHEN len(blockers) > 0 THEN 'medium' ELSE 'unknown' END AS removal_risk FROM ({0})"""
_SUSPECTS = f"""WITH e AS (SELECT e.*, f.path FROM edges e JOIN files f ON f.id = e.file_id),
 i AS (SELECT target_name AS name, bool_or(kind IN {_KINDS} AND NOT {_NARROW.format(p='path')}) AS used, bool_or(kind = 'import') AS imported, bool_or(kind = 'tests' OR {_NARROW.format(p='path')}) AS tested, {_FLAGS} FROM e GROUP BY 1), o AS (SELECT source_name AS name, {_FLAGS} FROM e GROUP BY 1),
 s AS (SELECT s.*, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path NOT LIKE ':%') """ + _RANKED.format(f"""
 SELECT s.id, s.name, s.path, s.start_line AS line, list_sort(list_filter([CASE WHEN NOT coalesce(i.used, false) THEN 'no_incoming_production_edges' END, CASE WHEN NOT coalesce(i.imported, false) THEN 'no_incoming_imports' END, CASE WHEN NOT coalesce(i.tested, false) THEN 'no_static_test_evidence' END,
   CASE WHEN s.visibility IN ('private', 'internal') OR NOT s.is_exported THEN 'private_or_internal' END, CASE WHEN i.name IS NULL AND o.name IS NULL THEN 'isolated_static_graph_node' END], lambda x: x IS NOT NULL)) AS reasons,
  list_sort(list_filter([CASE WHEN i.used THEN 'incoming_production_edge' END, CASE WHEN i.tested THEN 'static_test_evidence' END, CASE WHEN s.visibility = 'public' OR s.is_exported THEN 'public_api_surface' END, CASE WHEN s.kind = 'route' OR starts_with(s.name, 'ROUTE ') OR i.route OR o.route THEN 'route_entrypoint' END,
   CASE WHEN s.kind IN ('config', 'resource') OR i.config OR o.config THEN 'operational_config_resource' END, CASE WHEN s.kind = 'field' AND (i.field OR o.field) THEN 'field_access_evidence' END, CASE WHEN s.kind IN ('class', 'interface', 'type') AND (i.kin OR o.kin) THEN 'inheritance_or_implementation_evidence' END,
   CASE WHEN {_SPECIAL.format(p='s.path')} THEN 'special_file_convention' END], lambda x: x IS NOT NULL)) AS blockers, coalesce(i.unsure, false) OR coalesce(o.unsure, false) AS uncertain FROM s LEFT JOIN i ON i.name = s.name LEFT JOIN o ON o.name = s.name""")


@query("ev_symbol_suspects", _SUSPECTS)
def symbol_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for and against each symbol's being unused."""
    return E.symbol_suspects(*_tables(spark, sf_dir, "symbols", "edges", "files"))


@query("ev_suspects", f"SELECT id, name, suspect_strength, removal_risk FROM ({_SUSPECTS}) ORDER BY CASE suspect_strength WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, CASE removal_risk WHEN 'unknown' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, line, id LIMIT 50")
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first suspects by strength, risk and place."""
    rows = E.symbol_suspects(*_tables(spark, sf_dir, "symbols", "edges", "files"))
    by = lambda c, order: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return rows.orderBy(by("suspect_strength", ("strong", "moderate", "weak")), by("removal_risk", ("unknown", "medium", "high")), "path", "line", "id").limit(50).select("id", "name", "suspect_strength", "removal_risk")


@query("ev_file_suspects", f"""WITH d AS (SELECT DISTINCT s.name, s.file_id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path NOT LIKE ':%' AND s.name IS NOT NULL), n AS (SELECT name, count(*) AS n FROM d GROUP BY name),
 u AS (SELECT DISTINCT e.target_name AS name, e.file_id AS from_file, e.kind = 'import' AS imp FROM edges e JOIN files f ON f.id = e.file_id WHERE e.kind IN {_KINDS} AND NOT {_NARROW.format(p='f.path')}),
 x AS (SELECT d.file_id, bool_or(n.n = 1 AND u.imp) AS imports, bool_or(n.n = 1 AND NOT u.imp) AS usage, bool_or(n.n > 1) AS ambiguous FROM d JOIN n ON n.name = d.name JOIN u ON u.name = d.name AND u.from_file <> d.file_id GROUP BY d.file_id) """ + _RANKED.format(f"""
 SELECT f.id AS file_id, f.path, list_filter([CASE WHEN NOT coalesce(x.usage, false) THEN 'contained_symbols_have_no_incoming_production_edges' END, CASE WHEN NOT coalesce(x.imports, false) THEN 'file_has_no_incoming_imports' END], lambda v: v IS NOT NULL) AS reasons,
  list_sort(list_filter([CASE WHEN x.imports THEN 'incoming_import_evidence' END, CASE WHEN x.usage THEN 'contained_symbol_usage' END, CASE WHEN f.id NOT IN (SELECT file_id FROM d) THEN 'no_indexed_symbols' END, CASE WHEN {_NARROW.format(p='f.path')} THEN 'test_file' END, CASE WHEN {_SPECIAL.format(p='f.path')} THEN 'special_file_convention' END], lambda v: v IS NOT NULL)) AS blockers,
  coalesce(x.ambiguous, false) AS ambiguous FROM files f LEFT JOIN x ON x.file_id = f.id WHERE f.path NOT LIKE ':%'"""))
def file_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for and against each file's being unused."""
    return E.file_suspects(*_tables(spark, sf_dir, "symbols", "edges", "files"))


# the changed lines of these queries: those of all suspect candidates, whose files count as new where the language is missing
_LINES = "ln AS (SELECT DISTINCT file AS path, coalesce(line, 1) AS line, language IS NULL AS is_new FROM suspect_candidates)"
_CHANGED = f"""{_LINES}, sp AS (SELECT f.path, s.name, s.start_line, coalesce(s.end_line, s.start_line) AS end_line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IS NOT NULL), ins AS (SELECT ln.path, ln.line, sp.name FROM ln JOIN sp ON sp.path = ln.path AND ln.line BETWEEN sp.start_line AND sp.end_line WHERE NOT is_new),
 ch AS (SELECT path, name FROM ins UNION SELECT path, NULL FROM ln WHERE NOT is_new AND (path, line) NOT IN (SELECT (path, line) FROM ins) UNION SELECT ln.path, sp.name FROM ln LEFT JOIN sp ON sp.path = ln.path WHERE is_new)"""


def _changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "suspect_candidates")
    return c.select(F.col("file").alias("path"), F.coalesce("line", F.lit(1)).alias("line"), F.col("language").isNull().alias("is_new"))


@query("ev_changed_symbols", f"WITH {_CHANGED} SELECT * FROM ch")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that changed lines stand in."""
    return E.changed_symbols(_changed_lines(spark, sf_dir), *_tables(spark, sf_dir, "symbols", "files"))


_REACH = """hops AS (SELECT a.src, a.dst, CASE WHEN c.n IS NULL THEN 1 WHEN c.n = 1 THEN 2 ELSE 0 END AS rank FROM (SELECT DISTINCT source_name AS src, target_name AS dst FROM edges WHERE source_name <> target_name {where}) a LEFT JOIN (SELECT name, count(*) AS n FROM symbols GROUP BY name) c ON c.name = a.dst),
 w0 AS (SELECT DISTINCT name AS seed, name, 0 AS distance, 2 AS rank FROM {start})""" + "".join(
    f", w{k} AS (SELECT w.seed, h.src AS name, {k} AS distance, max(least(w.rank, h.rank)) AS rank FROM w{k - 1} w JOIN hops h ON h.dst = w.name WHERE (w.seed, h.src) NOT IN (SELECT (seed, name) FROM ({' UNION ALL '.join(f'SELECT seed, name FROM w{j}' for j in range(k))})) GROUP BY w.seed, h.src)"
    for k in range(1, 4)
)
_IMPACT = f"WITH {_CHANGED}, " + _REACH.format(where="AND kind NOT IN ('raises', 'catches', 'tests')", start="ch WHERE name IS NOT NULL") + """ SELECT name, distance, rank, CASE distance WHEN 1 THEN 'will_break' WHEN 2 THEN 'likely_affected' ELSE 'may_need_testing' END AS tier FROM (
 SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, rank DESC) AS r FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)) WHERE r = 1"""


@query("ev_change_impact", _IMPACT)
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on changed symbols."""
    return E.change_impact(_changed_lines(spark, sf_dir), *_tables(spark, sf_dir, "symbols", "files", "edges"))


@query("ev_change_risk", f"SELECT *, CASE WHEN affected = 0 THEN 'low' WHEN will_break > 0 AND best > 0 THEN 'high' WHEN will_break > 0 OR likely_affected > 0 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT count(*) AS affected, count(CASE WHEN tier = 'will_break' THEN 1 END) AS will_break, count(CASE WHEN tier = 'likely_affected' THEN 1 END) AS likely_affected, count(CASE WHEN tier = 'may_need_testing' THEN 1 END) AS may_need_testing, coalesce(max(rank), 0) AS best FROM ({_IMPACT}))".replace("SELECT *, CASE", "SELECT * EXCLUDE (best), CASE", 1))
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall risk of the changes."""
    return E.change_risk(change_impact(spark, sf_dir))


@query("ev_affected_tests", f"""WITH {_LINES}, st AS (SELECT DISTINCT s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path IN (SELECT path FROM ln) AND s.name IS NOT NULL), """ + _REACH.format(where="", start="st") + f""",
 r AS (SELECT DISTINCT name FROM (SELECT name FROM w1 UNION ALL SELECT name FROM w2 UNION ALL SELECT name FROM w3)), t AS (SELECT f.path, count(DISTINCT s.name) AS dependents FROM symbols s JOIN r ON r.name = s.name JOIN files f ON f.id = s.file_id WHERE {_IS_TEST.format(p='f.path')} GROUP BY f.path),
 d AS (SELECT DISTINCT path FROM ln WHERE {_IS_TEST.format(p='path')}) SELECT coalesce(t.path, d.path) AS path, d.path IS NOT NULL AS direct, coalesce(t.dependents, 0) AS dependents FROM t FULL JOIN d ON d.path = t.path""")
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test files that changes within three hops ask for."""
    changed = table(spark, sf_dir, "suspect_candidates").select(F.col("file").alias("path"))
    return E.affected_tests(changed, *_tables(spark, sf_dir, "symbols", "files", "edges"), depth=3)
