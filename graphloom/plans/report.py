"""Reports over the whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import report as P
from graphloom.operators.repos import owned
from graphloom.plans import query, sql_query
from graphloom.plans.graph import _BOTH, busiest_container
from graphloom.session import table

_OWN = """ow AS (SELECT id, repo_alias AS repo, rest FROM (SELECT f.id, r.repo_alias, substr(f.path, length(r.repo_root) + 2) AS rest, row_number() OVER (PARTITION BY f.id ORDER BY length(r.repo_root) DESC) AS n FROM files f JOIN workspace_repos r ON starts_with(f.path, r.repo_root || '/')) WHERE n = 1)"""
_TREE = f"""WITH {_OWN}, ar AS (SELECT file_id, cluster_id::VARCHAR AS area FROM (SELECT file_id, cluster_id, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, cluster_id) AS r FROM symbols WHERE cluster_id IS NOT NULL GROUP BY file_id, cluster_id) WHERE r = 1),
 fl AS (SELECT ow.repo, ow.rest AS path, len(string_split(ow.rest, '/')) AS depth, true AS is_file, 1 AS files, (SELECT count(*) FROM symbols s WHERE s.file_id = ow.id) AS symbols, ar.area FROM ow LEFT JOIN ar ON ar.file_id = ow.id),
 up AS (SELECT repo, symbols, array_to_string(string_split(path, '/')[1:i], '/') AS path, i AS depth FROM (SELECT *, unnest(generate_series(0, depth - 1)) AS i FROM fl)), fo AS (SELECT repo, path, depth, false AS is_file, count(*) AS files, sum(symbols)::BIGINT AS symbols FROM up GROUP BY ALL)"""


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.structure(owned(table(spark, sf_dir, "files"), table(spark, sf_dir, "workspace_repos")), table(spark, sf_dir, "symbols"))


def _areas(depth: int) -> str:
    sql, parent = "", "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
    for d in range(depth, -1, -1):
        below = f"SELECT repo, path, area FROM fl WHERE depth = {d + 1}" + (f" UNION ALL SELECT repo, path, area FROM a{d + 1}" if d < depth else "")
        sql += f", a{d} AS (SELECT f.repo, f.path, v.area FROM fo f LEFT JOIN (SELECT repo, p, area FROM (SELECT repo, p, area, row_number() OVER (PARTITION BY repo, p ORDER BY count(*) DESC, area) AS r FROM (SELECT repo, {parent} AS p, area FROM ({below}) WHERE area IS NOT NULL) GROUP BY repo, p, area) WHERE r = 1) v ON v.repo = f.repo AND v.p = f.path WHERE f.depth = {d})"
    return sql


_WHOLE = _TREE + _areas(12) + ", av AS (" + " UNION ALL ".join(f"SELECT * FROM a{d}" for d in range(13)) + ") "


@query("rep_structure", _WHOLE + "SELECT repo, path, depth::INT AS depth, is_file, files::BIGINT AS files, symbols, area FROM fl UNION ALL SELECT fo.repo, fo.path, fo.depth::INT, fo.is_file, fo.files, fo.symbols, av.area FROM fo JOIN av ON av.repo = fo.repo AND av.path = fo.path")
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files of all repositories with what they hold and their area."""
    return _structure(spark, sf_dir)


@query("rep_structure_page", _TREE + """, n AS (SELECT repo, path, depth, is_file FROM fl UNION ALL SELECT repo, path, depth, is_file FROM fo), t AS (SELECT *, CASE WHEN depth = 0 THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM n WHERE depth <= 2),
 g AS (SELECT *, sum(c) OVER (ORDER BY depth, repo, parent NULLS FIRST) AS upto FROM (SELECT depth, repo, parent, count(*) AS c FROM t GROUP BY ALL)), k AS (SELECT t.* FROM t JOIN g ON g.depth = t.depth AND g.repo = t.repo AND g.parent IS NOT DISTINCT FROM t.parent WHERE g.upto <= 120)
 SELECT k.repo, k.path, k.depth::INT AS depth, k.is_file, (SELECT count(*) FROM n b WHERE b.repo = k.repo AND b.path <> k.path AND (k.path = '' OR starts_with(b.path, k.path || '/'))) - (SELECT count(*) FROM k b WHERE b.repo = k.repo AND b.path <> k.path AND (k.path = '' OR starts_with(b.path, k.path || '/'))) AS hidden FROM k""")
def structure_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 nodes of the two upper levels, with what is hidden below each."""
    return P.capped_tree(_structure(spark, sf_dir), 2, 120).select("repo", "path", "depth", "is_file", "hidden")


@query("rep_layout")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 names of highest degree in space."""
    rows = P.layout(table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols"))
    return rows.withColumns({c: F.round(c, 3) for c in "xyz"})


_DEGREE = "dg AS (SELECT name, count(*) AS degree FROM (SELECT unnest([source_name, target_name]) AS name FROM (SELECT DISTINCT source_name, target_name FROM edges WHERE source_name <> target_name)) GROUP BY name)"


@query("rep_layout_nodes", f"WITH {_DEGREE} SELECT dg.name, dg.degree, c.cluster_id FROM dg JOIN (SELECT name, arg_min_null(cluster_id, id) AS cluster_id FROM symbols GROUP BY name) c ON c.name = dg.name ORDER BY degree DESC, dg.name LIMIT 300")
def layout_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are placed, with degree and cluster."""
    return P.layout(table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")).select("name", "degree", "cluster_id")


_CONTEXT = """WITH e AS (SELECT DISTINCT source_name AS src, target_name AS dst, kind FROM edges WHERE source_name <> target_name), c AS (SELECT name, arg_min_null(kind, id) AS kind FROM symbols WHERE name <> '' GROUP BY name),
 mb AS (SELECT DISTINCT split_part(name, '.', 1) AS owner, list_last(string_split(name, '.')) AS bare FROM symbols WHERE name LIKE '%.%'),
 al AS (SELECT name, name AS match FROM c UNION SELECT name, list_last(string_split(name, '.')) FROM c WHERE name LIKE '%.%' AND name NOT LIKE '%.' UNION SELECT c.name, bare FROM c JOIN mb ON mb.owner = c.name WHERE c.kind IN ('class', 'interface', 'struct') AND c.name NOT LIKE '%.%' AND bare <> ''),
 i AS (SELECT DISTINCT al.name, e.src AS other, e.kind FROM e JOIN al ON al.match = e.dst), o AS (SELECT DISTINCT al.name, e.dst AS other, e.kind FROM e JOIN al ON al.match = e.src), d AS (SELECT s.name, count(*) AS definitions, arg_min_null(f.path, s.id) AS path, arg_min_null(s.cluster_id, s.id) AS cluster_id FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name <> '' GROUP BY s.name),
 ci AS (SELECT name, count(DISTINCT CASE WHEN kind <> 'tests' THEN other END) AS callers, count(DISTINCT CASE WHEN kind = 'tests' THEN other END) AS tests, count(DISTINCT CASE WHEN kind = 'reads' THEN other END) AS readers, count(DISTINCT CASE WHEN kind = 'writes' THEN other END) AS writers, list_sort(list(DISTINCT CASE WHEN kind <> 'tests' THEN other END))[1:20] AS fc FROM i GROUP BY name),
 co AS (SELECT name, count(DISTINCT CASE WHEN kind <> 'tests' THEN other END) AS callees, list_sort(list(DISTINCT CASE WHEN kind <> 'tests' THEN other END))[1:20] AS fc FROM o GROUP BY name), p AS (SELECT cluster_id, count(DISTINCT name) - 1 AS peers FROM symbols WHERE cluster_id IS NOT NULL GROUP BY cluster_id)
 SELECT d.name, d.definitions, d.path, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(tests, 0) AS tests, coalesce(readers, 0) AS readers, coalesce(writers, 0) AS writers, coalesce(peers, 0) AS peers, list_filter(coalesce(ci.fc, []), lambda x: x IS NOT NULL) AS first_callers, list_filter(coalesce(co.fc, []), lambda x: x IS NOT NULL) AS first_callees
 FROM d LEFT JOIN ci ON ci.name = d.name LEFT JOIN co ON co.name = d.name LEFT JOIN p ON p.cluster_id = d.cluster_id"""


@query("rep_context", _CONTEXT)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every name, over its other names."""
    s = table(spark, sf_dir, "symbols")
    return P.context(s, table(spark, sf_dir, "edges"), table(spark, sf_dir, "files"), s.where("name <> ''"))


@query("rep_pack_neighbours", """WITH adj AS (SELECT DISTINCT source_name AS src, target_name AS dst FROM edges WHERE source_name <> target_name), nb AS (SELECT src AS name, dst AS neighbour FROM adj UNION SELECT dst, src FROM adj), dg AS (SELECT name, count(*) AS n FROM nb GROUP BY name),
 fs AS (SELECT s.name, min(s.id) AS id, arg_min(f.path, s.id) AS path FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY s.name),
 r AS (SELECT nb.name, nb.neighbour, fs.path, dg.n::DOUBLE AS score, fs.id, list_has_any(list_slice(string_split(fs.path, '/'), 1, -2), ['test', 'tests']) OR regexp_matches(lower(fs.path), '(^|/)(conftest|test_[^/]*)\\.py$|_test\\.py$|\\.(spec|test)\\.[jt]sx?$') AS t FROM nb JOIN fs ON fs.name = nb.neighbour JOIN dg ON dg.name = nb.neighbour WHERE nb.name IN (SELECT name FROM symbols WHERE kind = 'class')),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY score DESC, t, id) AS a FROM r) WHERE a <= 3) SELECT name, neighbour, path, score, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, t, id) AS place FROM f) WHERE place <= 10""")
def pack_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours to show with every class, by their degree, few of a file."""
    s, adj = table(spark, sf_dir, "symbols"), G.adjacency(table(spark, sf_dir, "edges")).select("src", "dst").distinct()
    both = adj.select(F.col("src").alias("name"), F.col("dst").alias("neighbour")).union(adj.select("dst", "src")).distinct()
    degree = both.groupBy(F.col("name").alias("neighbour")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    mine = both.join(s.where("kind = 'class'").select("name"), "name", "left_semi").join(degree, "neighbour")
    return P.pack_neighbours(mine, s, table(spark, sf_dir, "files"))


@query("rep_plan", f"""WITH r AS ({_BOTH}), it AS (SELECT name AS symbol, path, CASE WHEN direction = 'upstream' AND distance = 1 THEN 'direct_caller' WHEN direction = 'downstream' AND distance = 1 THEN 'direct_callee' ELSE 'impact' END AS reason, tier, rank FROM r UNION ALL SELECT name, path, 'test', tier, rank FROM r WHERE is_test),
 m AS (SELECT symbol, path, list_sort(list(DISTINCT reason)) AS reasons, min(list_position(['target', 'direct_caller', 'direct_callee', 'impact', 'test', 'peer'], reason)) AS f, min(list_position(['will_break', 'likely_affected', 'may_need_testing'], tier)) AS t, max(rank) AS rank, count(*) AS evidence FROM it GROUP BY symbol, path)
 SELECT symbol, path, reasons, ['will_break', 'likely_affected', 'may_need_testing'][t] AS tier, rank, evidence FROM m ORDER BY f, t NULLS LAST, rank DESC NULLS LAST, path NULLS LAST, symbol LIMIT 50""")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at before the busiest container is changed."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    r = G.blast_radius(e, s, table(spark, sf_dir, "files"), busiest_container(e, s), "both", 2)
    reason = F.when((F.col("direction") == "upstream") & (F.col("distance") == 1), "direct_caller").when((F.col("direction") == "downstream") & (F.col("distance") == 1), "direct_callee").otherwise("impact")
    items = r.select(F.col("name").alias("symbol"), "path", reason.alias("reason"), "tier", "rank").unionByName(r.where("is_test").select(F.col("name").alias("symbol"), "path", F.lit("test").alias("reason"), "tier", "rank"))
    return P.plan(items)


@query("rep_goldens", """WITH c AS (SELECT tool, args['q'] AS query, session_id, ts, symbol_names FROM tool_calls WHERE tool IS NOT NULL AND args['q'] IS NOT NULL), n AS (SELECT tool, query, ts, session_id, unnest(symbol_names) AS name, generate_subscripts(symbol_names, 1) - 1 AS pos FROM c),
 f AS (SELECT tool, query, name, min(struct_pack(ts := ts, session_id := session_id, pos := pos)) AS seen FROM n WHERE name IS NOT NULL GROUP BY tool, query, name),
 o AS (SELECT query, min(name) AS name FROM n WHERE name IS NOT NULL GROUP BY query), g AS (SELECT DISTINCT c.tool, c.query FROM (SELECT DISTINCT tool, query FROM c) c JOIN o ON o.query = c.query WHERE (c.tool, c.query, o.name) NOT IN (SELECT (tool, query, name) FROM f))
 SELECT s.tool, s.query, s.calls, s.sessions, coalesce(x.found, 0) AS found, coalesce(x.first, []) AS first, (s.tool, s.query) IN (SELECT (tool, query) FROM g) AS gap FROM (SELECT tool, query, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM c GROUP BY tool, query) s
 LEFT JOIN (SELECT tool, query, count(*) AS found, (list(name ORDER BY seen, name))[1:10] AS first FROM f GROUP BY tool, query) x ON x.tool = s.tool AND x.query = s.query""")
def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by tool and query: what they found, and whether they missed the first name that any tool found for that query."""
    c = table(spark, sf_dir, "tool_calls").select("tool", F.try_element_at("args", F.lit("q")).alias("query"), "session_id", "ts", "symbol_names")
    outcome = c.where("tool IS NOT NULL AND query IS NOT NULL").select("query", F.explode("symbol_names").alias("name")).where("name IS NOT NULL").groupBy("query").agg(F.min("name").alias("name"))
    return P.goldens(c, outcome)


@query("rep_snippets", """WITH u AS (SELECT s.*, f.path, f.file_hash, left(sha1(f.path), 8) || ':' || s.start_line AS uid FROM symbols s JOIN files f ON f.id = s.file_id), r AS (SELECT u.*, t.text AS txt, string_split(t.text, chr(10)) AS l FROM u LEFT JOIN file_sources t ON t.path = u.path WHERE u.kind = 'class'),
 x AS (SELECT *, greatest(start_line - 2, 1) AS a, least(coalesce(end_line, start_line) + 2, len(l)) AS e FROM r), y AS (SELECT *, least(e, a + 39) AS z FROM x)
 SELECT uid, id, name, path, a AS first_line, z AS last_line, left(array_to_string(l[a:z], chr(10)), 2000) AS text, z < e OR length(array_to_string(l[a:z], chr(10))) > 2000 AS truncated, sha1(txt) = file_hash AS fresh FROM y""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every class with two lines around, bounded to 40 lines and 2,000 characters."""
    s, f = table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files")
    from graphloom.functions.text import uid

    wanted = s.where("kind = 'class'").join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select(uid(F.col("path"), F.col("start_line")).alias("uid"))
    rows = P.snippets(wanted, s, f, table(spark, sf_dir, "file_sources"), 2, 40, 2000)
    return rows.join(s.where("kind = 'class'").select("id"), "id", "left_semi")


@query("rep_budget_ceiling", "SELECT source, count(CASE WHEN used > 80000 THEN 1 END) AS dropped FROM (SELECT source, sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) GROUP BY source")
def budget_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source do not fit into 100,000 characters of which 20,000 are kept free."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return P.within_ceiling(d, ["source"], [F.col("doc_id")], F.col("n"), 100_000, 20_000)[1]


@query("rep_budget_trim", """WITH s AS (SELECT kind AS section, dense_rank() OVER (ORDER BY kind) AS priority, id AS place, length(name) AS size FROM symbols WHERE name IS NOT NULL), t AS (SELECT section, priority, sum(size) AS n FROM s GROUP BY ALL), r AS (SELECT section, 20000 - coalesce(sum(n) OVER (ORDER BY priority, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t)
 SELECT section, place FROM (SELECT s.section, s.place, r.room, sum(size) OVER (PARTITION BY s.section ORDER BY place ROWS UNBOUNDED PRECEDING) AS u FROM s JOIN r ON r.section = s.section) WHERE u <= room""")
def budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by kind, of which those stay that fit into 20,000 characters when the last kinds are cut first."""
    s = table(spark, sf_dir, "symbols").where("name IS NOT NULL")
    kinds = {r["kind"]: i for i, r in enumerate(s.select("kind").distinct().orderBy("kind").collect(), 1)}  # a handful of kinds
    rank = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    return P.trimmed(s.select(F.col("kind").alias("section"), rank.alias("priority"), F.col("id").alias("place"), F.length("name").alias("size")), 20_000).select("section", "place")


@query("rep_steer", f"SELECT direction, tier, 'showing ' || shown || ' of ' || entries || '; ask for a limit above 5 or fewer hops' AS hint FROM (SELECT direction, tier, count(*) AS entries, least(count(*), 5) AS shown FROM ({_BOTH}) GROUP BY direction, tier) WHERE entries > 5")
def steer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints on what a short list of the radius leaves out."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return P.steer(G.risk_summary(G.blast_radius(e, s, table(spark, sf_dir, "files"), busiest_container(e, s), "both", 2), 5), 5)


# ---------------------------------------------------------------- sections of a briefing, each one statement
sql_query("rep_schema_counts", "SELECT 'files' AS what, count(*) AS n FROM {files} UNION ALL SELECT 'symbols', count(*) FROM {symbols} UNION ALL SELECT 'edges', count(*) FROM {edges} UNION ALL SELECT 'vectors', count(*) FROM {symbol_vectors} UNION ALL SELECT 'synthesized_edges', count(synthesized_by) FROM {edges} UNION ALL SELECT 'documented_symbols', count(docstring) FROM {symbols} UNION ALL SELECT 'clustered_symbols', count(cluster_id) FROM {symbols}")
sql_query("rep_schema_breakdowns", "SELECT 'symbol_kind' AS what, kind AS value, count(*) AS n FROM {symbols} GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM {edges} GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM {files} GROUP BY language UNION ALL SELECT 'visibility', visibility, count(*) FROM {symbols} GROUP BY visibility UNION ALL SELECT 'confidence', confidence, count(*) FROM {edges} GROUP BY confidence UNION ALL SELECT 'provenance', provenance, count(*) FROM {edges} GROUP BY provenance")
sql_query("rep_capabilities", "SELECT count(CASE WHEN kind = 'tests' THEN 1 END) > 0 AS has_test_edges, count(CASE WHEN kind IN ('reads', 'writes') THEN 1 END) > 0 AS has_field_access, count(CASE WHEN kind = 'http_calls' THEN 1 END) > 0 AS has_http_calls, count(CASE WHEN kind IN ('raises', 'catches') THEN 1 END) > 0 AS has_exception_edges, count(CASE WHEN kind = 'reads_config' THEN 1 END) > 0 AS has_reads_config, count(synthesized_by) > 0 AS has_synthesized FROM {edges}")
sql_query("rep_hotspots", "SELECT target_name AS name, count(*) AS incoming, count(DISTINCT source_name) AS callers, count(DISTINCT kind) AS kinds FROM {edges} WHERE source_name <> target_name GROUP BY target_name ORDER BY incoming DESC, name LIMIT 25")
sql_query("rep_orchestrators", "SELECT source_name AS name, count(*) AS outgoing, count(CASE WHEN kind = 'call' THEN 1 END) AS calls, count(CASE WHEN kind = 'instantiates' THEN 1 END) AS made, count(CASE WHEN kind IN ('reads', 'writes') THEN 1 END) AS accesses FROM {edges} WHERE source_name <> target_name GROUP BY source_name ORDER BY outgoing DESC, name LIMIT 25")
sql_query("rep_exceptions", "SELECT source_name AS name, count(CASE WHEN kind = 'raises' THEN 1 END) AS raises, count(CASE WHEN kind = 'catches' THEN 1 END) AS catches, count(CASE WHEN kind = 'catches' AND target_name IN ('Exception', 'BaseException') THEN 1 END) AS broad FROM {edges} WHERE kind IN ('raises', 'catches') GROUP BY source_name ORDER BY raises + catches DESC, name LIMIT 25".replace("ORDER BY raises + catches DESC", "ORDER BY count(*) DESC"))
sql_query("rep_untested_hotspots", "SELECT e.target_name AS name, count(*) AS incoming FROM {edges} e WHERE e.source_name <> e.target_name AND e.kind <> 'tests' AND NOT EXISTS (SELECT 1 FROM {edges} t WHERE t.kind = 'tests' AND t.target_name = e.target_name) GROUP BY e.target_name ORDER BY incoming DESC, name LIMIT 25")
sql_query("rep_config_readers", "SELECT target_name AS config, count(DISTINCT source_name) AS readers, count(DISTINCT file_id) AS files FROM {edges} WHERE kind = 'reads_config' GROUP BY target_name")
sql_query("rep_cluster_members", "SELECT cluster_id, name, min(id) AS first_id, count(*) AS definitions FROM {symbols} WHERE cluster_id IS NOT NULL GROUP BY cluster_id, name")
sql_query("rep_drift", "SELECT count(*) AS looked_at, count(CASE WHEN mtime > indexed_at THEN 1 END) AS changed FROM (SELECT mtime, indexed_at FROM {files} WHERE path NOT LIKE ':%' ORDER BY mtime DESC, id LIMIT 200) t")
sql_query("rep_common_root", "SELECT min(path) AS first_path, max(path) AS last_path, count(*) AS files FROM {files} WHERE path LIKE '/%'")
sql_query("rep_readiness", "SELECT v.model, count(*) AS vectors, count(s.id) AS current, count(*) - count(s.id) AS orphans FROM {symbol_vectors} v LEFT JOIN {symbols} s ON s.id = v.symbol_id GROUP BY v.model")
