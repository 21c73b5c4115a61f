"""Queries of ingest, upkeep, budgets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import store, sync
from graphloom.plans import query, sql_query
from graphloom.session import shared_dir, table
from graphloom.sources import ingest
from graphloom.streaming import sessions as S

_LINES = "(SELECT {k}, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM {t} WHERE text IS NOT NULL)"


@query("ing_comment_markers", rf"SELECT path, line, upper(m) AS marker FROM (SELECT path, line, regexp_extract(content, '^\s*(?:#|//|\*|/\*+)\s*(WHY|HACK|NOTE|TODO|FIXME)\b', 1) AS m FROM {_LINES.format(k='path', t='file_sources')}) WHERE m <> ''")
def comment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked comments of all sources."""
    return ingest.comment_markers(table(spark, sf_dir, "file_sources"))


@query("ing_headings", rf"""WITH h AS (SELECT doc_id, line, length(regexp_extract(content, '^(#{{1,6}})\s+\S', 1))::INT AS level, trim(regexp_replace(content, '^#{{1,6}}\s+|\s+#+\s*$|\r$', '', 'g')) AS title FROM {_LINES.format(k='doc_id', t='documents')} WHERE regexp_matches(content, '^(#{{1,6}})\s+\S'))
 SELECT a.*, (SELECT min(b.line) - 1 FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS last_line, (SELECT max(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level) AS parent FROM h a""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown headings of all documents with their extent and parent."""
    return ingest.headings(table(spark, sf_dir, "documents"))


@query("ing_references", rf"""WITH l AS (SELECT * FROM {_LINES.format(k='doc_id', t='documents')})
 SELECT DISTINCT doc_id, line, 'code' AS ref_kind, unnest(regexp_extract_all(content, '`([^`\n]+)`', 1)) AS value FROM l""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code spans of all documents."""
    return ingest.references(table(spark, sf_dir, "documents")).where("ref_kind = 'code'")


@query("ing_python_symbols")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of all Python sources."""
    f = table(spark, sf_dir, "files").where("language = 'python'").select("path")
    rows = ingest.extract_python(table(spark, sf_dir, "file_sources").join(f, "path", "left_semi"))
    return rows.where("row_kind = 'symbol'").select("path", "name", "kind", "start_line", "end_line", "docstring", "signature", "visibility")


@query("ing_python_edges")
def python_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all Python sources with their same-file confidence."""
    f = table(spark, sf_dir, "files").where("language = 'python'").select("path")
    return ingest.same_file_confidence(ingest.extract_python(table(spark, sf_dir, "file_sources").join(f, "path", "left_semi")))


@query("sync_snapshot_diff", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.file_hash IS NOT DISTINCT FROM sha1(b.text) THEN 'unchanged' ELSE 'modified' END AS status FROM files a FULL JOIN file_sources b ON a.path = b.path")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every indexed file, by the hash of its present text."""
    now = table(spark, sf_dir, "file_sources").select("path", F.sha1(F.col("text").cast("binary")).alias("file_hash"))
    return sync.compare(table(spark, sf_dir, "files"), now, "path", "file_hash")


sql_query("sync_stale_files", "SELECT id, CASE WHEN mtime > indexed_at THEN 'stale' ELSE 'fresh' END AS verdict FROM {files} WHERE path NOT LIKE ':%'")
sql_query("sync_embedding_plan", "SELECT coalesce(s.id, v.symbol_id) AS symbol_id, CASE WHEN v.symbol_id IS NULL THEN 'embed' WHEN s.id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM {symbols} s FULL JOIN {symbol_vectors} v ON v.symbol_id = s.id")
sql_query("sync_version_token", "SELECT model, concat(count(*), ':', max(symbol_id)) AS token FROM {symbol_vectors} GROUP BY model")


@query("budget_prefix", "SELECT doc_id, source FROM (SELECT doc_id, source, sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY updated_at NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 100000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest documents of each source, as many as fit into 100,000 characters."""
    d = table(spark, sf_dir, "documents")
    return sync.within_budget(d.select("doc_id", "source", "updated_at", F.length("text").alias("n")), ["source"], [F.col("updated_at").asc_nulls_first(), F.col("doc_id")], F.col("n"), 100_000).select("doc_id", "source")


_SESSIONS = """WITH c AS (SELECT DISTINCT session_id, CAST(ts * 1000000 AS BIGINT) AS us, tool, event FROM tool_calls WHERE session_id IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 1800000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY session_id ORDER BY us)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT session_id, count(*) AS calls, (max(us) - min(us)) // 1000000 AS seconds FROM n GROUP BY session_id, s"""


@query("stream_sessions_batch", _SESSIONS)
def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of tool calls without a pause of half an hour."""
    s = S.sessions(table(spark, sf_dir, "tool_calls"))
    return s.select("session_id", "calls", F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000).alias("seconds"))


@query("stream_tool_counts", "SELECT tool, count(DISTINCT call_id) AS calls FROM tool_calls GROUP BY tool")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every tool, counted by a stream that upserts into a table and ends with its input."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    calls = S.calls_stream(spark, f"{sf_dir}/tool_calls.parquet").select("call_id", "tool", "received_at")
    S.upsert_stream(calls, f"{base}/checkpoint", "call_id", "received_at", put).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("call_id").agg(F.max_by("tool", "batch").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))


@query("stream_latest_calls", "SELECT session_id, arg_max(call_id, struct_pack(a := received_at, b := call_id)) AS call_id FROM tool_calls WHERE session_id IS NOT NULL GROUP BY session_id")
def latest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest call of every session, kept by a stream of debounced upserts into a table of buckets."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    calls = S.calls_stream(spark, f"{sf_dir}/tool_calls.parquet").select("session_id", "call_id", "received_at").where("session_id IS NOT NULL")
    store.create(spark.createDataFrame([], calls.schema), f"{base}/table", "session_id", 8)

    def put(df: DataFrame, number: int) -> None:
        # a batch may be older than what is stored: the newest of both stays
        now = store.read(df.sparkSession, f"{base}/table").join(df.select("session_id"), "session_id", "left_semi").select(*df.columns) if number else df.limit(0)
        best = df.unionByName(now).groupBy("session_id").agg(F.max_by(F.struct("session_id", "call_id", "received_at"), F.struct("received_at", "call_id")).alias("r")).select("r.*")
        store.change(f"{base}/table", "session_id", df.select("session_id").limit(0), best, 8)

    S.upsert_stream(calls, f"{base}/checkpoint", "session_id", ["received_at", "call_id"], put).awaitTermination()
    return store.read(spark, f"{base}/table").select("session_id", "call_id")


# ---------------------------------------------------------------- composite reads
sql_query(
    "rep_symbol_context",
    """SELECT d.name, d.definitions, d.first_id, coalesce(i.callers, 0) AS callers, coalesce(o.callees, 0) AS callees, coalesce(t.tests, 0) AS tests FROM (SELECT name, count(*) AS definitions, min(id) AS first_id FROM {symbols} GROUP BY name) d
       LEFT JOIN (SELECT target_name, count(DISTINCT source_name) AS callers FROM {edges} WHERE kind <> 'tests' GROUP BY target_name) i ON i.target_name = d.name
       LEFT JOIN (SELECT source_name, count(DISTINCT target_name) AS callees FROM {edges} WHERE kind <> 'tests' GROUP BY source_name) o ON o.source_name = d.name
       LEFT JOIN (SELECT target_name, count(DISTINCT source_name) AS tests FROM {edges} WHERE kind = 'tests' GROUP BY target_name) t ON t.target_name = d.name""",
)
sql_query(
    "rep_suspects",
    """SELECT s.id, CASE WHEN i.n IS NULL THEN 'no references' WHEN i.extracted = 0 THEN 'only uncertain references' ELSE 'referenced' END AS reason FROM {symbols} s
       LEFT JOIN (SELECT target_name, count(*) AS n, count(CASE WHEN confidence = 'EXTRACTED' THEN 1 END) AS extracted FROM {edges} WHERE source_name <> target_name GROUP BY target_name) i ON i.target_name = s.name WHERE s.kind IN ('function', 'method', 'class')""",
)
# peers come from the size of a cluster, not from pairs of its members
_PEERS = "SELECT a.name, m.members - 1 AS peers FROM (SELECT name, {first} AS cluster_id FROM {symbols} GROUP BY name) a JOIN (SELECT cluster_id, count(DISTINCT name) AS members FROM {symbols} GROUP BY cluster_id) m ON m.cluster_id = a.cluster_id WHERE m.members > 1"
sql_query("rep_cluster_peers", _PEERS.replace("{first}", "min_by(cluster_id, id)"), _PEERS.replace("{first}", "arg_min_null(cluster_id, id)").replace("{symbols}", "symbols"))
sql_query(
    "rep_trace_gaps",
    "SELECT tool, count(*) AS calls, count(CASE WHEN result_count = 0 THEN 1 END) AS empty_results, count(DISTINCT session_id) AS sessions FROM {tool_calls} GROUP BY tool",
)
