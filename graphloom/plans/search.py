"""Structural searches, each with a statement written for it alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.search import Search, graph_search, recipe
from graphloom.plans import query
from graphloom.session import table

_TEST = "(contains('/' || lower({p}), '/test/') OR contains('/' || lower({p}), '/tests/') OR regexp_matches(lower({p}), '_test\\.py$|\\.(test|spec)\\.(ts|js)$'))"
_IN = _TEST.format(p="path")
_S = """WITH s AS (SELECT s.*, f.path, f.language, left(sha1(f.path), 8) || ':' || s.start_line AS uid FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path NOT LIKE ':%'),
 c AS (SELECT name, count(*) AS n FROM s WHERE {scope} GROUP BY name),
 e AS (SELECT e.id, e.source_name, e.target_name, e.kind, e.synthesized_by, CASE WHEN e.kind = 'call' AND e.provenance IN ('python-receiver-type', 'typescript-receiver-type', 'javascript-receiver-type') AND c.n = 1 THEN 'EXTRACTED'
   WHEN e.kind = 'call' AND e.provenance IN ('python-receiver-type', 'typescript-receiver-type', 'javascript-receiver-type') AND c.n > 1 THEN 'AMBIGUOUS' ELSE e.confidence END AS confidence FROM edges e LEFT JOIN c ON c.name = e.target_name),
 k AS (SELECT * FROM e WHERE {edge}), i AS (SELECT target_name AS name, count(*) AS n FROM k GROUP BY 1), o AS (SELECT source_name AS name, count(*) AS n FROM k GROUP BY 1),
 d AS (SELECT s.id, s.name AS symbol, s.kind, s.path, s.start_line AS line, s.uid, s.visibility, s.cluster_id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree
   FROM s LEFT JOIN i ON i.name = s.name LEFT JOIN o ON o.name = s.name WHERE {scope} AND {symbol})
 SELECT *, count(*) OVER () AS total FROM d WHERE {degree} ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


def _sql(symbol: str = "true", edge: str = "true", degree: str = "true", order: str = "symbol, path, line, id", limit: int = 20, offset: int = 0, scope: str = "true") -> str:
    return _S.format(symbol=symbol, edge=edge, degree=degree, order=order, limit=limit, offset=offset, scope=scope)


def _run(search: Search) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph_search(*(table(spark, sf_dir, t) for t in ("symbols", "edges", "files")), search)

    return run


query("gs_hotspots", _sql(scope=f"NOT {_IN}", degree="incoming >= 2", order="incoming DESC, symbol, path, line, id"))(_run(recipe("production-hotspots")))
query("gs_orchestrators", _sql(scope=f"NOT {_IN}", degree="outgoing >= 2", order="outgoing DESC, symbol, path, line, id", limit=50))(_run(recipe("fan-out-orchestrators", limit=50)))
query("gs_dead_code", _sql(symbol="s.kind = 'function'", scope=f"NOT {_IN}", edge="kind = 'call'", degree="incoming <= 0", limit=100))(_run(recipe("dead-code-suspects", limit=500)))
query("gs_isolates", _sql(scope=f"NOT {_IN}", degree="degree <= 0"))(_run(recipe("isolated-symbols")))
query("gs_field_access", _sql(symbol="s.kind = 'field'", edge="kind IN ('reads', 'writes')", degree="degree > 0", limit=30))(
    lambda spark, sf_dir: _run(recipe("field-access", limit=30))(spark, sf_dir).drop("preview", "preview_more")
)
query("gs_glob_page", _sql(symbol="s.language = 'python' AND regexp_matches(s.name, '^[a-m].*[eE].*$') AND regexp_matches(s.path, '^.*/src/.*$')", order="path, line, symbol, id", limit=10, offset=5))(
    _run(Search(name_pattern="[a-m]*[eE]*", file_pattern="*/src/*", language="python", sort="file", limit=10, offset=5))
)
query("gs_regex", _sql(symbol="regexp_matches(s.qualified_name, '(Cache|Index|Query)') AND s.visibility = 'public' AND s.is_exported", order="line, symbol, path, id", limit=100))(
    _run(Search(qualified_name_pattern="(Cache|Index|Query)", regex=True, visibility="public", is_exported=True, sort="line", limit=100))
)
query("gs_confident_callers", _sql(edge="kind = 'call' AND confidence = 'EXTRACTED' AND synthesized_by IS NULL", degree="outgoing > 0", order="degree DESC, symbol, path, line, id", limit=40))(
    _run(Search(edge_kind="call", confidence="EXTRACTED", synthesized="parser", direction="outgoing", sort="total-degree", limit=40))
)
query("gs_ambiguous_tests", _sql(scope=_IN, edge="confidence = 'AMBIGUOUS'", degree="degree > 0", limit=60))(_run(Search(confidence="AMBIGUOUS", test_scope="test", limit=60)))
query("gs_degree_bounds", _sql(symbol="s.cluster_id = 3", degree="degree >= 1 AND degree <= 40 AND outgoing <= 30"))(_run(Search(cluster_id=3, min_degree=1, max_degree=40, max_out_degree=30)))
query("gs_synthesized", _sql(edge="synthesized_by IS NOT NULL", degree="degree > 0", limit=60))(_run(Search(synthesized="synthesized", limit=60)))
_PREVIEW = """WITH p AS (""" + _sql(edge="kind IN ('extends', 'implements')", degree="degree > 0", limit=25) + """),
 x AS (SELECT p.id, 'incoming' AS direction, e.source_name AS other, e.kind, e.source_name, e.target_name, e.confidence FROM p JOIN edges e ON e.target_name = p.symbol WHERE e.kind IN ('extends', 'implements')
   UNION ALL SELECT p.id, 'outgoing', e.target_name, e.kind, e.source_name, e.target_name, e.confidence FROM p JOIN edges e ON e.source_name = p.symbol WHERE e.kind IN ('extends', 'implements')),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY direction, kind, source_name, target_name, coalesce(confidence, '')) AS r, count(*) OVER (PARTITION BY id) AS n FROM x)
 SELECT p.*, t.preview, t.preview_more FROM p LEFT JOIN (SELECT id, list(concat_ws(' ', direction, kind, other) ORDER BY r) AS preview, any_value(n) > 3 AS preview_more FROM r WHERE r <= 3 GROUP BY id) t ON t.id = p.id"""
query("gs_inheritance", _PREVIEW)(_run(recipe("inheritance-families", limit=25)))
