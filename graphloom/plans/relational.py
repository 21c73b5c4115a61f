"""Joins, aggregates, windows, top-k and set operations over the code index, each one statement for Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import sync
from graphloom.operators.repos import owned
from graphloom.plans import query, sql_query
from graphloom.session import table

# ---------------------------------------------------------------- joins
sql_query("join_symbols_files", "SELECT s.id, s.name, f.path, f.language FROM {symbols} s JOIN {files} f ON f.id = s.file_id")
sql_query("join_edges_files", "SELECT e.id, e.source_name, e.target_name, e.kind, f.path, f.language FROM {edges} e JOIN {files} f ON f.id = e.file_id WHERE e.source_name <> e.target_name AND f.path NOT LIKE ':%'")
# an OR of two equalities is written as a union of two equi-joins
sql_query(
    "join_neighbours_union",
    """SELECT s.id AS symbol_id, e.target_name AS neighbour FROM {symbols} s JOIN (SELECT DISTINCT source_name, target_name FROM {edges}) e ON e.source_name = s.name WHERE s.kind IN ('class', 'interface', 'struct')
       UNION SELECT s.id, e.source_name FROM {symbols} s JOIN (SELECT DISTINCT source_name, target_name FROM {edges}) e ON e.target_name = s.name WHERE s.kind IN ('class', 'interface', 'struct')""",
)
sql_query("join_edge_symbol_composite", "SELECT e.id, min(s.id) AS symbol_id FROM {edges} e LEFT JOIN {symbols} s ON s.file_id = e.file_id AND s.name = e.source_name GROUP BY e.id")
sql_query(
    "join_prev_next",
    """SELECT id, lag(id) OVER (PARTITION BY file_id ORDER BY start_line, id) AS prev_id, lead(id) OVER (PARTITION BY file_id ORDER BY start_line, id) AS next_id FROM {symbols}""",
)
sql_query(
    "join_nearest_symbol",
    """SELECT candidate_id, symbol_id FROM (SELECT c.candidate_id, s.id AS symbol_id, row_number() OVER (PARTITION BY c.candidate_id ORDER BY abs(s.start_line - c.line), s.id) AS r
       FROM {suspect_candidates} c JOIN {files} f ON f.path = c.file JOIN {symbols} s ON s.file_id = f.id WHERE c.line IS NOT NULL) t WHERE r <= 5""",
)
sql_query("join_anti_missing_vectors", "SELECT s.id FROM {symbols} s LEFT ANTI JOIN {symbol_vectors} v ON v.symbol_id = s.id", "SELECT s.id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM symbol_vectors v WHERE v.symbol_id = s.id)")
sql_query("join_anti_orphan_vectors", "SELECT v.symbol_id FROM {symbol_vectors} v LEFT ANTI JOIN {symbols} s ON v.symbol_id = s.id", "SELECT v.symbol_id FROM symbol_vectors v WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE v.symbol_id = s.id)")
sql_query("join_semi_defined_targets", "SELECT e.id FROM {edges} e WHERE EXISTS (SELECT 1 FROM {symbols} s WHERE s.name = e.target_name)")
sql_query(
    "join_overrides",
    """SELECT DISTINCT i.target_name AS base, i.source_name AS sub, substring(b.name, length(i.target_name) + 2) AS method
       FROM (SELECT DISTINCT source_name, target_name FROM {edges} WHERE kind IN ('extends', 'implements')) i
       JOIN (SELECT DISTINCT name, split_part(name, '.', 1) AS owner FROM {symbols} WHERE kind = 'method') b ON b.owner = i.target_name
       JOIN (SELECT DISTINCT name FROM {symbols} WHERE kind = 'method') m ON m.name = concat(i.source_name, substring(b.name, length(i.target_name) + 1)) WHERE b.name LIKE '%.%'""",
)
sql_query("join_declaring_files", "SELECT DISTINCT s.name, f.path FROM {symbols} s JOIN {files} f ON f.id = s.file_id WHERE s.name IN (SELECT target_name FROM {edges} WHERE kind = 'import')")
sql_query(
    "join_test_edges",
    """SELECT DISTINCT e.source_name, e.target_name FROM {edges} e JOIN {files} f ON f.id = e.file_id JOIN (SELECT DISTINCT s.name FROM {symbols} s JOIN {files} g ON g.id = s.file_id WHERE g.path NOT LIKE '%/tests/%') p ON p.name = e.target_name
       WHERE e.kind IN ('call', 'instantiates') AND f.path LIKE '%/tests/%'""",
)
sql_query("join_uid_definitions", "SELECT s.id, count(*) OVER (PARTITION BY s.file_id, s.start_line) AS rows_at_place FROM {symbols} s")

# ---------------------------------------------------------------- aggregates
sql_query("agg_name_count", "SELECT name, count(*) AS n FROM {symbols} GROUP BY name")
sql_query("agg_kind_count", "SELECT kind, count(*) AS n FROM {symbols} GROUP BY kind")
sql_query("agg_global_counts", "SELECT (SELECT count(*) FROM {files}) AS files, (SELECT count(*) FROM {symbols}) AS symbols, (SELECT count(*) FROM {edges}) AS edges")
sql_query(
    "agg_degrees",
    """SELECT n.name, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree FROM (SELECT DISTINCT name FROM {symbols}) n
       LEFT JOIN (SELECT target_name, count(*) AS d FROM {edges} WHERE source_name <> target_name GROUP BY target_name) i ON i.target_name = n.name
       LEFT JOIN (SELECT source_name, count(*) AS d FROM {edges} WHERE source_name <> target_name GROUP BY source_name) o ON o.source_name = n.name""",
)
sql_query("agg_hubs", "SELECT name, sum(d) AS degree FROM (SELECT source_name AS name, count(*) AS d FROM {edges} GROUP BY source_name UNION ALL SELECT target_name, count(*) FROM {edges} GROUP BY target_name) t GROUP BY name ORDER BY degree DESC, name LIMIT 20",
          "SELECT name, sum(d)::BIGINT AS degree FROM (SELECT source_name AS name, count(*) AS d FROM edges GROUP BY source_name UNION ALL SELECT target_name, count(*) FROM edges GROUP BY target_name) t GROUP BY name ORDER BY degree DESC, name LIMIT 20")
sql_query("agg_confidence_by_name_count", "SELECT CASE WHEN c.n IS NULL THEN 'INFERRED' WHEN c.n = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence, count(*) AS edges FROM {edges} e LEFT JOIN (SELECT name, count(*) AS n FROM {symbols} GROUP BY name) c ON c.name = e.target_name GROUP BY 1")
sql_query(
    "agg_inter_cluster",
    """SELECT a.cluster_id AS from_cluster, b.cluster_id AS to_cluster, count(*) AS weight FROM (SELECT DISTINCT source_name, target_name FROM {edges} WHERE source_name <> target_name) e
       JOIN (SELECT name, min(cluster_id) AS cluster_id FROM {symbols} GROUP BY name) a ON a.name = e.source_name JOIN (SELECT name, min(cluster_id) AS cluster_id FROM {symbols} GROUP BY name) b ON b.name = e.target_name
       WHERE a.cluster_id <> b.cluster_id GROUP BY a.cluster_id, b.cluster_id""",
)
sql_query("agg_language_counts", "SELECT f.language, count(DISTINCT f.id) AS files, count(s.id) AS symbols FROM {files} f LEFT JOIN {symbols} s ON s.file_id = f.id GROUP BY f.language")
sql_query("agg_edge_histograms", "SELECT kind, confidence, synthesized_by, grouping(kind) AS g_kind, grouping(confidence) AS g_confidence, grouping(synthesized_by) AS g_by, count(*) AS n FROM {edges} GROUP BY GROUPING SETS ((kind), (confidence), (synthesized_by))")
sql_query("agg_mode_cluster_per_file", "SELECT file_id, cluster_id FROM (SELECT file_id, cluster_id, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, cluster_id) AS r FROM {symbols} WHERE cluster_id IS NOT NULL GROUP BY file_id, cluster_id) t WHERE r = 1")
sql_query("agg_exception_histogram", "SELECT kind, target_name, count(*) AS n FROM {edges} WHERE kind IN ('raises', 'catches') GROUP BY kind, target_name")
sql_query("agg_test_coverage", "SELECT target_name, count(DISTINCT source_name) AS tests FROM {edges} WHERE kind = 'tests' GROUP BY target_name")
sql_query(
    "agg_best_confidence",
    """SELECT source_name, target_name, kind, max(CASE confidence WHEN 'EXTRACTED' THEN 2 WHEN 'INFERRED' THEN 1 WHEN 'AMBIGUOUS' THEN 0 ELSE 1 END) AS rank_best FROM {edges} GROUP BY source_name, target_name, kind""",
)
sql_query("agg_field_access", "SELECT target_name, count(DISTINCT CASE WHEN kind = 'reads' THEN source_name END) AS readers, count(DISTINCT CASE WHEN kind = 'writes' THEN source_name END) AS writers FROM {edges} WHERE kind IN ('reads', 'writes') GROUP BY target_name")
sql_query("agg_suspect_summary", "SELECT suspect_strength, removal_risk, count(*) AS n FROM {suspect_candidates} GROUP BY CUBE (suspect_strength, removal_risk)")
sql_query("agg_vector_versions", "SELECT model, count(*) AS n, max(symbol_id) AS newest FROM {symbol_vectors} GROUP BY model")
sql_query("agg_tool_latency", "SELECT tool, count(*) AS calls, sum(CASE WHEN elapsed_ms >= 100 THEN 1 ELSE 0 END) AS slow, round(avg(elapsed_ms), 6) AS mean_ms, max(elapsed_ms) AS worst_ms FROM {tool_calls} GROUP BY tool",
          "SELECT tool, count(*) AS calls, sum(CASE WHEN elapsed_ms >= 100 THEN 1 ELSE 0 END)::BIGINT AS slow, round(avg(elapsed_ms), 6) AS mean_ms, max(elapsed_ms) AS worst_ms FROM tool_calls GROUP BY tool")
sql_query("agg_documents_by_kind", "SELECT doc_kind, lower(trim(lang)) AS lang, count(*) AS docs, sum(length(text)) AS chars FROM {documents} GROUP BY doc_kind, lower(trim(lang))",
          "SELECT doc_kind, lower(trim(lang)) AS lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY doc_kind, lower(trim(lang))")
sql_query("agg_cluster_sizes", "SELECT cluster_id, count(DISTINCT name) AS members FROM {symbols} WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
sql_query(
    "agg_cluster_cohesion",
    """SELECT a.cluster_id, round(CAST(sum(CASE WHEN a.cluster_id = b.cluster_id THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS cohesion FROM (SELECT DISTINCT source_name, target_name FROM {edges} WHERE source_name <> target_name) e
       JOIN (SELECT name, min(cluster_id) AS cluster_id FROM {symbols} GROUP BY name) a ON a.name = e.source_name JOIN (SELECT name, min(cluster_id) AS cluster_id FROM {symbols} GROUP BY name) b ON b.name = e.target_name
       WHERE a.cluster_id IS NOT NULL GROUP BY a.cluster_id""",
)
sql_query("agg_entry_score", "SELECT name, coalesce(entry_score, 1.0) AS score FROM (SELECT name, entry_score, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM {symbols}) t WHERE r = 1")

# ---------------------------------------------------------------- windows, order, limits
sql_query("win_definition_count", "SELECT id, name, n FROM (SELECT id, name, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM {symbols}) t WHERE r = 1")
sql_query("win_first_by_path", "SELECT name, path, start_line FROM (SELECT s.name, f.path, s.start_line, row_number() OVER (PARTITION BY s.name ORDER BY f.path, s.start_line, s.id) AS r FROM {symbols} s JOIN {files} f ON f.id = s.file_id) t WHERE r = 1")
sql_query("win_per_file_cap", "SELECT id, file_id FROM (SELECT id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(entry_score, 1.0) DESC, name, id) AS r FROM {symbols}) t WHERE r <= 3")
sql_query("win_closing_interval", "SELECT id, start_line, lead(start_line) OVER (PARTITION BY file_id ORDER BY start_line, id) - 1 AS last_line FROM {symbols}")
sql_query("top_sort_suspects", "SELECT candidate_id, suspect_strength, removal_risk FROM {suspect_candidates} ORDER BY CASE suspect_strength WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END, CASE removal_risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file, coalesce(line, -1), candidate_id LIMIT 100")
sql_query("top_entry_points", "SELECT name, max(entry_score) AS score FROM {symbols} WHERE entry_score IS NOT NULL AND entry_score = entry_score GROUP BY name ORDER BY score DESC, name LIMIT 20")
sql_query("top_page", "SELECT id, name FROM {symbols} ORDER BY name, id LIMIT 100 OFFSET 200")

# ---------------------------------------------------------------- set operations
sql_query("set_endpoints_union", "SELECT source_name AS name FROM {edges} UNION SELECT target_name FROM {edges}")
sql_query("set_roots", "SELECT source_name AS name FROM {edges} WHERE kind = 'call' EXCEPT SELECT target_name FROM {edges} WHERE kind = 'call' AND source_name <> target_name")
sql_query("set_isolated", "SELECT name FROM {symbols} EXCEPT SELECT name FROM (SELECT source_name AS name FROM {edges} UNION SELECT target_name FROM {edges}) t")
sql_query("set_tested_and_called", "SELECT target_name AS name FROM {edges} WHERE kind = 'tests' INTERSECT SELECT target_name FROM {edges} WHERE kind = 'call'")

# ---------------------------------------------------------------- filters
sql_query("filter_structural", "SELECT s.id FROM {symbols} s JOIN {files} f ON f.id = s.file_id WHERE s.kind IN ('function', 'method') AND f.language = 'python' AND s.is_exported AND s.visibility = 'public' AND f.path NOT LIKE '%/tests/%'")
sql_query("filter_edges", "SELECT id FROM {edges} WHERE kind IN ('call', 'instantiates') AND confidence = 'EXTRACTED' AND synthesized_by IS NULL")
sql_query("filter_ilike", "SELECT id FROM {symbols} WHERE name ILIKE '%cache%'")
sql_query(
    "filter_degree_bounds",
    """SELECT n.name FROM (SELECT DISTINCT name FROM {symbols}) n LEFT JOIN (SELECT target_name, count(*) AS d FROM {edges} GROUP BY target_name) i ON i.target_name = n.name
       LEFT JOIN (SELECT source_name, count(*) AS d FROM {edges} GROUP BY source_name) o ON o.source_name = n.name WHERE coalesce(i.d, 0) = 0 AND coalesce(o.d, 0) >= 1""",
)
sql_query("filter_synthetic_edges", "SELECT e.id FROM {edges} e JOIN {files} f ON f.id = e.file_id WHERE e.synthesized_by IS NOT NULL AND f.path LIKE ':%'")


# ---------------------------------------------------------------- shaped for skew
sql_query("join_member_expansion", "SELECT c.name AS container, m.name AS member FROM (SELECT DISTINCT name FROM {symbols} WHERE kind IN ('class', 'interface', 'struct')) c JOIN (SELECT DISTINCT name, split_part(name, '.', 1) AS owner FROM {symbols} WHERE name LIKE '%.%') m ON m.owner = c.name")
sql_query("win_cap_with_truncation", "SELECT kind, least(count(*), 25) AS kept, greatest(count(*) - 25, 0) AS dropped FROM {edges} GROUP BY kind",
          "SELECT kind, count(CASE WHEN r <= 25 THEN 1 END) AS kept, count(CASE WHEN r > 25 THEN 1 END) AS dropped FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY source_name, target_name, id) AS r FROM edges) t GROUP BY kind")


@query("join_stabbing", """SELECT edge_id, symbol_id FROM (SELECT e.id AS edge_id, s.id AS symbol_id, row_number() OVER (PARTITION BY e.id ORDER BY s.end_line - s.start_line, s.id) AS r
       FROM edges e JOIN symbols s ON s.file_id = e.file_id AND e.line BETWEEN s.start_line AND s.end_line) t WHERE r = 1""")
def stabbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol that every edge stands in."""
    points = table(spark, sf_dir, "edges").select(F.col("id").alias("point"), "file_id", "line")
    spans = table(spark, sf_dir, "symbols").select(F.col("id").alias("span"), "file_id", "start_line", "end_line")
    return sync.innermost(points, spans).select(F.col("point").alias("edge_id"), F.col("span").alias("symbol_id"))


_OWNED = """owned AS (SELECT id, path, repo_alias, rest FROM (SELECT f.id, f.path, r.repo_alias, substr(f.path, length(r.repo_root) + 2) AS rest, row_number() OVER (PARTITION BY f.id ORDER BY length(r.repo_root) DESC NULLS LAST) AS n
 FROM files f LEFT JOIN workspace_repos r ON starts_with(f.path, r.repo_root || '/')) WHERE n = 1)"""


def over_repos(name: str, text: str) -> None:
    """A statement over tables in braces, of which {owned} has the files with their repositories; the same text over a plain
    derivation of that table is its SQL."""
    names = [t for t in ("files", "symbols", "edges", "suspect_candidates", "workspace_repos") if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mine = owned(table(spark, sf_dir, "files"), table(spark, sf_dir, "workspace_repos"))
        return spark.sql(text, owned=mine, **{t: table(spark, sf_dir, t) for t in names})

    plain = text.replace("{owned}", "owned")
    for t in names:
        plain = plain.replace("{" + t + "}", t)
    query(name, f"WITH {_OWNED} {plain}")(run)


over_repos("join_repo_files", "SELECT id, repo_alias FROM {owned} WHERE repo_alias IS NOT NULL")
over_repos("join_cross_repo_names", "SELECT s.name, count(DISTINCT o.repo_alias) AS repos FROM {symbols} s JOIN {owned} o ON o.id = s.file_id GROUP BY s.name HAVING count(DISTINCT o.repo_alias) >= 2")
over_repos(
    "agg_boundary_crosstab",
    """SELECT fa.repo_alias AS from_area, ta.area AS to_area, count(*) AS n, min(e.id) AS first_edge FROM {edges} e JOIN {owned} fa ON fa.id = e.file_id
       JOIN (SELECT s.name, min(o.repo_alias) AS area FROM {symbols} s JOIN {owned} o ON o.id = s.file_id GROUP BY s.name) ta ON ta.name = e.target_name WHERE fa.repo_alias <> ta.area GROUP BY fa.repo_alias, ta.area""",
)
over_repos("agg_dominant_folder", "SELECT repo, folder FROM (SELECT repo_alias AS repo, split_part(rest, '/', 1) AS folder, row_number() OVER (PARTITION BY repo_alias ORDER BY count(*) DESC, split_part(rest, '/', 1)) AS r FROM {owned} WHERE rest IS NOT NULL GROUP BY repo_alias, split_part(rest, '/', 1)) t WHERE r = 1")
over_repos("agg_rollup_area", "SELECT repo, folder, count(*) AS files FROM (SELECT repo_alias AS repo, split_part(rest, '/', 1) AS folder FROM {owned} WHERE rest IS NOT NULL) t GROUP BY ROLLUP (repo, folder)")
over_repos("rep_architecture_areas", "SELECT o.repo_alias AS repo, f.language, count(DISTINCT f.id) AS files, count(s.id) AS symbols, count(DISTINCT s.cluster_id) AS clusters FROM {files} f JOIN {owned} o ON o.id = f.id LEFT JOIN {symbols} s ON s.file_id = f.id WHERE f.path NOT LIKE ':%' GROUP BY o.repo_alias, f.language")
