"""Queries on documents and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.repos import owned
from graphloom.plans import query
from graphloom.session import cut, table
from graphloom.sources import documents as D
from graphloom.sources import languages

_LN = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents WHERE text IS NOT NULL)"
_H = _LN + r""", h0 AS (SELECT doc_id, line, length(regexp_extract(content, '^(#{1,6})\s+\S', 1))::INT AS level, trim(regexp_replace(content, '^#{1,6}\s+|\s+#+\s*$|\r$', '', 'g')) AS t FROM ln WHERE regexp_matches(content, '^(#{1,6})\s+\S')),
 h AS (SELECT doc_id, line, level, trim(regexp_replace(trim(regexp_replace(t, '\s+#+\s*$', '')), '<[^>]+>', '', 'g')) AS title FROM h0),
 x AS (SELECT a.*, (SELECT max(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level) AS parent, (SELECT min(b.line) - 1 FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS last_line FROM h a)"""
_ANCHORS = "WITH RECURSIVE " + _H + r""", p(doc_id, line, up, path) AS (SELECT doc_id, line, parent, title FROM x UNION ALL SELECT p.doc_id, p.line, x.parent, x.title || ' > ' || p.path FROM p JOIN x ON x.doc_id = p.doc_id AND x.line = p.up)
 SELECT x.doc_id, x.line AS start_line, x.last_line AS end_line, x.level, x.title, p.path AS heading_path, regexp_replace(regexp_replace(lower(x.title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM x JOIN p ON p.doc_id = x.doc_id AND p.line = x.line AND p.up IS NULL"""


@query("doc_anchors", _ANCHORS)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of all documents with their path and extent."""
    return D.anchors(table(spark, sf_dir, "documents")).drop("search_text")


_KIND = r"""CASE WHEN length(v) = 0 OR length(v) > 160 OR regexp_matches(v, '^https?://') THEN NULL WHEN regexp_matches(v, '^/[A-Za-z0-9_./{}:$*-]+$') THEN 'route' WHEN regexp_matches(v, '^[A-Z][A-Z0-9_]{2,}$') THEN 'config'
 WHEN contains(v, '/') OR regexp_matches(v, '\.(py|ts|tsx|js|jsx|go|rs|java|cs|rb|c|cc|cpp|h|hpp|php|swift|md|markdown)$') THEN 'file' WHEN regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$') AND length(v) > 2 THEN 'symbol' END"""
_REFS = _LN + rf""", sp AS (SELECT DISTINCT doc_id, line, {_KIND} AS target_kind, v AS target_value FROM (SELECT doc_id, line, unnest(regexp_extract_all(content, '`([^`\n]{{1,180}})`', 1)) AS v FROM ln)),
 lk AS (SELECT DISTINCT doc_id, line, CASE WHEN regexp_matches(lower(v), '\.(md|markdown)$') THEN 'doc' WHEN regexp_matches(lower(v), '\.(py|ts|tsx|js|jsx|go|rs|java|cs|rb|c|cc|cpp|h|hpp|php|swift)$') THEN 'file' END AS target_kind, v AS target_value
   FROM (SELECT doc_id, line, regexp_replace(trim(regexp_replace(v, '#.*$', '')), '^\./', '') AS v FROM (SELECT doc_id, line, unnest(regexp_extract_all(content, '\[[^\]]+\]\(([^)]+)\)', 1)) AS v FROM ln)) WHERE NOT regexp_matches(v, '^([a-z]+://|mailto:)') AND v <> ''),
 wd AS (SELECT doc_id, line, unnest(string_split(regexp_replace(content, '#', ' #', 'g'), ' ')) AS w, content FROM ln),
 rf AS (SELECT *, CASE target_kind WHEN 'symbol' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, 'code-span' AS provenance FROM sp WHERE target_kind IS NOT NULL UNION ALL SELECT *, 'EXACT', 'markdown-link' FROM lk WHERE target_kind IS NOT NULL)"""


@query("doc_references", f"WITH {_REFS} SELECT * FROM rf")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents refer to by code spans and links (issue numbers are tested by hand)."""
    return D.references(table(spark, sf_dir, "documents")).where("target_kind <> 'issue'")


_RESOLVED = _REFS + r""", ow AS (SELECT path, repo_alias, rest FROM (SELECT f.path, r.repo_alias, substr(f.path, length(r.repo_root) + 2) AS rest, row_number() OVER (PARTITION BY f.id ORDER BY length(r.repo_root) DESC) AS n FROM files f JOIN workspace_repos r ON starts_with(f.path, r.repo_root || '/')) WHERE n = 1),
 nm AS (SELECT v, min(name) AS hit FROM (SELECT name, name AS v, id FROM symbols UNION SELECT name, qualified_name, id FROM symbols) WHERE v IS NOT NULL GROUP BY v HAVING count(DISTINCT id) = 1),
 rs AS (SELECT rf.doc_id, rf.line, rf.target_kind, rf.target_value, rf.provenance, rf.confidence AS c, d.doc_kind, CASE rf.target_kind WHEN 'symbol' THEN (SELECT hit FROM nm WHERE nm.v = rf.target_value) WHEN 'doc' THEN rf.target_value
   WHEN 'file' THEN (SELECT CASE WHEN count(*) = 1 THEN min(path) END FROM ow WHERE ow.repo_alias = d.source AND (ow.rest = rf.target_value OR ends_with(ow.rest, '/' || rf.target_value))) END AS resolved_value FROM rf JOIN documents d ON d.doc_id = rf.doc_id)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, symbols, files, repos = (table(spark, sf_dir, t) for t in ("documents", "symbols", "files", "workspace_repos"))
    return D.resolve_references(D.references(docs).where("target_kind <> 'issue'"), docs, symbols, owned(files, repos))


@query("doc_resolved", f"WITH {_RESOLVED} SELECT doc_id, line, target_kind, target_value, CASE WHEN resolved_value IS NOT NULL THEN target_kind END AS resolved_kind, resolved_value, CASE WHEN resolved_value IS NULL THEN 'LOW' ELSE c END AS confidence, provenance FROM rs")
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the references of all documents stand for in the index."""
    return _resolved(spark, sf_dir)


_GROUND = "WITH RECURSIVE " + _ANCHORS.removeprefix("WITH RECURSIVE ").split(" SELECT x.doc_id, x.line AS start_line")[0] + ", " + _RESOLVED.removeprefix(_LN + ", ") + r""",
 an AS (SELECT x.doc_id, x.line AS start_line, coalesce(x.last_line, 1073741824) AS end_line, p.path FROM x JOIN p ON p.doc_id = x.doc_id AND p.line = x.line AND p.up IS NULL),
 g AS (SELECT rs.doc_id, rs.line, (SELECT an.path FROM an WHERE an.doc_id = rs.doc_id AND rs.line BETWEEN an.start_line AND an.end_line ORDER BY an.start_line DESC LIMIT 1) AS heading_path, rs.target_kind, rs.target_value, rs.resolved_value, CASE WHEN resolved_value IS NULL THEN 'LOW' ELSE c END AS confidence, rs.doc_kind FROM rs)"""


def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return D.grounding(_resolved(spark, sf_dir), D.anchors(docs), docs)


@query("doc_grounding", _GROUND + " SELECT * FROM g ORDER BY CASE confidence WHEN 'EXACT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, resolved_value IS NULL, doc_id, line, target_kind, target_value LIMIT 200")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred best references of documents to the index, under which heading they stand."""
    return _grounding(spark, sf_dir).orderBy(*D.grounding_order()).limit(200)


@query("doc_grounding_summary", _GROUND + " SELECT doc_kind, confidence, count(*) AS n FROM g GROUP BY doc_kind, confidence")
def grounding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by kind of document and confidence."""
    return _grounding(spark, sf_dir).groupBy("doc_kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("path", "language")
    return languages.extract(table(spark, sf_dir, "file_sources").join(files, "path"))


@query("ing_symbols")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of all sources in all languages."""
    return _extracted(spark, sf_dir).where("row_kind = 'symbol'").select("path", "name", "kind", "start_line", "end_line", "docstring", "signature", "visibility")


@query("ing_edges")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all sources in all languages."""
    return _extracted(spark, sf_dir).where("row_kind = 'edge'").select("path", "source_name", "target_name", "kind", "receiver", "line")


@query("ing_indexed_again", """SELECT f.language, s.kind, count(DISTINCT (s.file_id, s.name, s.start_line)) AS indexed FROM symbols s JOIN files f ON f.id = s.file_id JOIN file_sources t ON t.path = f.path
 WHERE f.language IN ('go', 'java', 'c', 'javascript', 'typescript') AND s.kind <> 'field' AND length(t.text) > 0 GROUP BY f.language, s.kind""")
def indexed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the indexed symbols of five languages the extraction finds anew, at the same name, kind and line."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path", "language")
    found = cut(_extracted(spark, sf_dir).where("row_kind = 'symbol'").select("path", "name", "kind", "start_line")).join(files, "path").distinct()
    known = table(spark, sf_dir, "symbols").select("file_id", "name", "kind", "start_line").distinct()
    rows = found.join(known, ["file_id", "name", "kind", "start_line"]).where(F.col("language").isin("go", "java", "c", "javascript", "typescript"))
    return rows.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("indexed"))


@query("doc_config_reads")
def config_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sources read configuration."""
    return D.config_reads(*(table(spark, sf_dir, t) for t in ("file_sources", "files", "symbols")))


@query("doc_http_calls")
def http_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client calls in sources to routes of this system."""
    return D.http_calls(*(table(spark, sf_dir, t) for t in ("file_sources", "files", "symbols")))
