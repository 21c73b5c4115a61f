"""Graph queries over the whole edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans import query
from graphloom.session import table

# the seed of a walk is a parameter of the query: here the most referenced defined name, the first of equals
_SEED = """seed AS (SELECT e.target_name AS name FROM edges e WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.name = e.target_name) GROUP BY e.target_name ORDER BY count(*) DESC, e.target_name LIMIT 1)"""
_HOPS = """counts AS (SELECT name, count(*) AS n FROM symbols GROUP BY name),
 hops AS (SELECT a.src, a.dst, CASE WHEN c.n IS NULL THEN 1 WHEN c.n = 1 THEN 2 ELSE 0 END AS rank, a.kind, a.synthesized_by FROM (SELECT DISTINCT source_name AS src, target_name AS dst, kind, synthesized_by FROM edges WHERE source_name <> target_name {where}) a LEFT JOIN counts c ON c.name = a.dst)"""
_UP = """,
 {p}{k} AS (SELECT name, {k} AS distance, rank, kind, synthesized_by FROM (SELECT h.{far} AS name, least(p.rank, h.rank) AS rank, h.kind, h.synthesized_by,
  row_number() OVER (PARTITION BY h.{far} ORDER BY least(p.rank, h.rank) DESC, p.name, h.kind NULLS FIRST, h.synthesized_by NULLS FIRST) AS r
  FROM {p}{j} p JOIN hops h ON h.{near} = p.name WHERE h.{far} NOT IN (SELECT name FROM ({before}))) WHERE r = 1)"""


def _chain(depth: int, near: str, far: str, prefix: str = "l") -> str:
    sql = ""
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT name FROM {prefix}{i}" for i in range(k))
        sql += _UP.format(k=k, j=k - 1, near=near, far=far, before=before, p=prefix)
    return sql


def _levels(depth: int, near: str, far: str, where: str) -> str:
    sql = "WITH " + _SEED + ", " + _HOPS.format(where=where) + ", l0 AS (SELECT name, 0 AS distance, 2 AS rank, NULL::VARCHAR AS kind, NULL::VARCHAR AS synthesized_by FROM seed)"
    return sql + _chain(depth, near, far) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, depth + 1)) + ")"


def seed(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The most referenced defined name, the first of equals."""
    return edges.select(F.col("target_name").alias("name")).join(symbols.select("name"), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(1).select("name")


_IMPACT = _levels(3, "dst", "src", "AND kind NOT IN ('raises', 'catches', 'tests')")


@query("graph_impact", f"SELECT name, distance, rank, CASE distance WHEN 1 THEN 'will_break' WHEN 2 THEN 'likely_affected' ELSE 'may_need_testing' END AS tier FROM ({_IMPACT})")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blast radius of the most referenced name."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.impact(e, s, seed(e, s))


@query("graph_impact_summary", f"SELECT distance, count(*) AS names, min(rank) AS weakest FROM ({_IMPACT}) GROUP BY distance")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and weakest rank of each distance of the blast radius, counted before any cap."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.impact(e, s, seed(e, s)).groupBy("distance").agg(F.count(F.lit(1)).alias("names"), F.min("rank").alias("weakest"))


@query("graph_walk_downstream", _levels(3, "src", "dst", ""))
def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the most referenced name depends on, within three hops."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.walk(G.resolved(G.adjacency(e), s), seed(e, s), "downstream", 3)


@query("graph_callers", f"WITH {_SEED} SELECT DISTINCT e.target_name AS name, e.source_name AS caller, e.kind FROM edges e JOIN seed ON seed.name = e.target_name WHERE e.source_name <> e.target_name")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of the most referenced name."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.callers(G.adjacency(e), seed(e, s))


@query("graph_callees", "SELECT DISTINCT e.source_name AS name, e.target_name AS callee, e.kind FROM edges e WHERE e.source_name <> e.target_name AND e.source_name IN (SELECT name FROM symbols WHERE kind = 'class')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every class refers to."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.callees(G.adjacency(e), s.where("kind = 'class'"))


@query("graph_roots", "SELECT DISTINCT source_name AS name FROM edges WHERE kind = 'call' AND source_name <> target_name AND source_name IN (SELECT name FROM symbols) AND source_name NOT IN (SELECT target_name FROM edges WHERE kind = 'call' AND source_name <> target_name)")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points: defined names that call and are not called."""
    return G.roots(table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols"))


_NAMES = """t AS (SELECT name FROM symbols WHERE kind IN ('class', 'interface', 'struct') GROUP BY name HAVING count(*) >= 1 ORDER BY (SELECT count(*) FROM edges e WHERE e.target_name = symbols.name) DESC, name LIMIT 1),
 starts AS (SELECT name FROM t UNION SELECT s.name FROM symbols s JOIN t ON starts_with(s.name, t.name || '.') UNION SELECT list_last(string_split(s.name, '.')) FROM symbols s JOIN t ON starts_with(s.name, t.name || '.'))"""


def busiest_container(edges: DataFrame, symbols: DataFrame) -> str:
    """The name of the class, interface or struct that most edges lead to, the first of equals."""
    known = symbols.where("kind IN ('class', 'interface', 'struct')").select("name").distinct()
    counts = edges.groupBy(F.col("target_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    row = known.join(counts, "name", "left").orderBy(F.coalesce("n", F.lit(0)).desc(), "name").first()
    return row["name"] if row else ""


_STEM = "regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '')"
_IS_TEST = "(list_has_any(list_slice(string_split({p}, '/'), 1, -2), ['test', 'tests']) OR regexp_matches(lower({p}), '(^|/)(conftest|test_[^/]*)\\.py$|_test\\.py$') OR regexp_matches(lower({p}), '\\.(spec|test)\\.[jt]sx?$'))"
_BOTH = (
    "WITH " + _NAMES + ", " + _HOPS.format(where="AND kind NOT IN ('raises', 'catches', 'tests')")
    + ", u0 AS (SELECT name, 0 AS distance, 2 AS rank, NULL::VARCHAR AS kind, NULL::VARCHAR AS synthesized_by FROM starts), d0 AS (SELECT * FROM u0)"
    + _chain(2, "dst", "src", "u") + _chain(2, "src", "dst", "d")
    + ", r AS (SELECT 'upstream' AS direction, * FROM u1 UNION ALL SELECT 'upstream', * FROM u2 UNION ALL SELECT 'downstream', * FROM d1 UNION ALL SELECT 'downstream', * FROM d2)"
    + ", p AS (SELECT s.name, min(f.path) AS path FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY s.name)"
    + f", stems AS (SELECT {_STEM} AS name FROM files WHERE path NOT LIKE ':%' GROUP BY 1 HAVING bool_and({_IS_TEST.format(p='path')}))"
    + f" SELECT r.direction, r.name, r.distance, r.rank, CASE r.distance WHEN 1 THEN 'will_break' ELSE 'likely_affected' END AS tier, p.path, coalesce({_IS_TEST.format(p='p.path')}, stems.name IS NOT NULL) AS is_test, r.kind, r.synthesized_by"
    + " FROM r LEFT JOIN p ON p.name = r.name LEFT JOIN stems ON stems.name = r.name"
)


def _radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.blast_radius(e, s, table(spark, sf_dir, "files"), busiest_container(e, s), "both", 2)


@query("graph_impact_both", _BOTH)
def impact_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of impact of the most referenced container with its members, two hops, with paths and tests."""
    return _radius(spark, sf_dir)


@query("graph_impact_surface", f"SELECT direction, tier, count(*) AS entries, least(count(*), 25)::BIGINT AS shown, greatest(count(*) - 25, 0)::BIGINT AS dropped FROM ({_BOTH}) WHERE NOT is_test GROUP BY direction, tier")
def impact_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk summary of that radius without tests, counted before lists are capped."""
    return G.risk_summary(_radius(spark, sf_dir).where("NOT is_test"))


@query("graph_aliases", """WITH c AS (SELECT name, arg_min(kind, id) AS kind FROM symbols WHERE name IS NOT NULL AND name <> '' GROUP BY name), m AS (SELECT DISTINCT split_part(name, '.', 1) AS owner, list_last(string_split(name, '.')) AS bare FROM symbols WHERE name LIKE '%.%')
 SELECT name, name AS match FROM c UNION SELECT name, list_last(string_split(name, '.')) FROM c WHERE name LIKE '%.%' AND name NOT LIKE '%.' UNION SELECT c.name, m.bare FROM c JOIN m ON m.owner = c.name WHERE c.kind IN ('class', 'interface', 'struct') AND c.name NOT LIKE '%.%' AND m.bare <> ''""")
def all_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which names the edges of every defined name are looked up."""
    s = table(spark, sf_dir, "symbols")
    return G.aliases(s, s)


@query("graph_components", """WITH RECURSIVE e AS (SELECT DISTINCT source_name AS a, target_name AS b FROM edges WHERE kind IN ('extends', 'implements') AND source_name <> target_name),
 l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS name FROM l), r(name, far) AS (SELECT name, name FROM n UNION SELECT r.name, l.b FROM r JOIN l ON l.a = r.far)
 SELECT name, min(far) AS component FROM r GROUP BY name""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected component of every name under inheritance."""
    e = G.adjacency(table(spark, sf_dir, "edges")).where("kind IN ('extends', 'implements')")
    return G.components(e.select("src", "dst"))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.clusters(*(table(spark, sf_dir, t) for t in ("edges", "symbols", "files")))


@query("graph_communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the clusters of defined names; tests compare them with a plain version of the algorithm."""
    return _clusters(spark, sf_dir)[1]


@query("graph_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with label, size and cohesion."""
    rows = _clusters(spark, sf_dir)[0]
    return rows.withColumn("cohesion", F.round("cohesion", 6))


_PPR_GRAPH = """adj AS (SELECT DISTINCT source_name AS a, target_name AS b FROM edges WHERE source_name <> target_name), u AS (SELECT a, b FROM adj UNION SELECT b, a FROM adj), g0 AS (SELECT name FROM seed),
 g1 AS (SELECT DISTINCT u.b AS name FROM u JOIN g0 ON g0.name = u.a WHERE u.b NOT IN (SELECT name FROM g0) ORDER BY 1 LIMIT (500 - (SELECT count(*) FROM g0))),
 g2 AS (SELECT DISTINCT u.b AS name FROM u JOIN g1 ON g1.name = u.a WHERE u.b NOT IN (SELECT name FROM g0 UNION SELECT name FROM g1) ORDER BY 1 LIMIT (500 - (SELECT count(*) FROM g0) - (SELECT count(*) FROM g1))),
 g3 AS (SELECT DISTINCT u.b AS name FROM u JOIN g2 ON g2.name = u.a WHERE u.b NOT IN (SELECT name FROM g0 UNION SELECT name FROM g1 UNION SELECT name FROM g2) ORDER BY 1 LIMIT (500 - (SELECT count(*) FROM g0) - (SELECT count(*) FROM g1) - (SELECT count(*) FROM g2))),
 g AS (SELECT name FROM g0 UNION ALL SELECT name FROM g1 UNION ALL SELECT name FROM g2 UNION ALL SELECT name FROM g3), i AS MATERIALIZED (SELECT u.a, u.b FROM u WHERE a IN (SELECT name FROM g) AND b IN (SELECT name FROM g)),
 n AS MATERIALIZED (SELECT a AS name, count(*) AS d, CASE WHEN a IN (SELECT name FROM seed) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM i GROUP BY a), r0 AS MATERIALIZED (SELECT name, s AS x FROM n)"""
# a round changes nothing once the one before moved less than the tolerance
_PPR = "WITH " + _SEED + ", " + _PPR_GRAPH + ", z0 AS MATERIALIZED (SELECT false AS s)" + "".join(
    f", f{k} AS (SELECT i.b AS name, sum(r.x / n.d) AS f FROM i JOIN r{k - 1} r ON r.name = i.a JOIN n ON n.name = i.a GROUP BY i.b)"
    f", r{k} AS MATERIALIZED (SELECT n.name, CASE WHEN (SELECT s FROM z{k - 1}) THEN r.x ELSE 0.85 * coalesce(f.f, 0) + 0.15 * n.s END AS x FROM n JOIN r{k - 1} r ON r.name = n.name LEFT JOIN f{k} f ON f.name = n.name)"
    f", z{k} AS MATERIALIZED (SELECT sum(abs(a.x - b.x)) < 1e-6 AS s FROM r{k} a JOIN r{k - 1} b ON b.name = a.name)"
    for k in range(1, 31)
) + " SELECT name, round(x, 9) AS score FROM r30"


@query("graph_pagerank", _PPR)
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance to the most referenced name of the names around it: personalised PageRank on at most 500 names."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    return G.relevance(G.adjacency(e), seed(e, s)).select("name", F.round("score", 9).alias("score"))


_TRACE = (
    "WITH " + _SEED + ", " + _HOPS.format(where="") + ", u0 AS (SELECT name, 0 AS distance, 2 AS rank, NULL::VARCHAR AS kind, NULL::VARCHAR AS synthesized_by FROM seed)" + _chain(4, "dst", "src", "u")
    + ", start AS (SELECT name FROM (SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3 UNION ALL SELECT * FROM u4) ORDER BY distance DESC, name LIMIT 1), t0 AS (SELECT name, NULL::VARCHAR AS parent, NULL::VARCHAR AS kind FROM start)"
    + "".join(
        f", t{k} AS (SELECT dst AS name, min(struct_pack(src := src, kind := hops.kind)).src AS parent, min(struct_pack(src := src, kind := hops.kind)).kind AS kind FROM hops JOIN t{k - 1} t ON t.name = hops.src WHERE dst NOT IN ({' UNION ALL '.join(f'SELECT name FROM t{j}' for j in range(k))}) GROUP BY dst)"
        for k in range(1, 5)
    )
    + ", every AS (" + " UNION ALL ".join(f"SELECT {k} AS hop, * FROM t{k}" for k in range(1, 5)) + ")"
    + ", b4 AS (SELECT e.hop, e.parent AS src, e.name AS dst, e.kind FROM every e JOIN seed ON seed.name = e.name)"
    + "".join(f", b{k} AS (SELECT * FROM b{k + 1} UNION SELECT e.hop, e.parent, e.name, e.kind FROM every e JOIN b{k + 1} b ON b.src = e.name AND b.hop = e.hop + 1)" for k in (3, 2, 1))
    + " SELECT hop::INT AS hop, src, dst, kind FROM b1"
)


@query("graph_trace", _TRACE)
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path to the most referenced name from the first of the names farthest upstream of it."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    adj, target = G.adjacency(e), seed(e, s)
    source = G.walk(G.resolved(adj, s), target, "upstream", 4).orderBy(F.desc("distance"), "name").first()
    goal = target.first()
    return G.trace(adj, source["name"] if source else "", goal["name"] if goal else "")


@query("graph_entry_points", """WITH RECURSIVE adj AS (SELECT DISTINCT source_name AS src, target_name AS dst FROM edges WHERE source_name <> target_name), d AS (SELECT s.name, arg_min_null(s.kind, s.id) AS kind, arg_min_null(f.path, s.id) AS path, arg_min_null(s.entry_score, s.id) AS score FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY s.name),
 roots AS (SELECT d.* FROM d WHERE name IN (SELECT src FROM adj) AND name NOT IN (SELECT dst FROM adj) AND NOT """ + _IS_TEST.format(p="path") + """),
 w(origin, name, depth) AS (SELECT name, name, 0 FROM roots UNION SELECT w.origin, adj.dst, w.depth + 1 FROM w JOIN adj ON adj.src = w.name WHERE w.depth < 5), n AS (SELECT origin, count(DISTINCT name) - 1 AS reach FROM w GROUP BY origin)
 SELECT r.name, r.kind, r.path, n.reach, coalesce(CASE WHEN isnan(r.score) THEN NULL ELSE r.score END, 1.0) * n.reach AS score FROM roots r JOIN n ON n.origin = r.name ORDER BY score DESC, r.name LIMIT 20""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points ranked by entry score times reach."""
    return G.entry_points(*(table(spark, sf_dir, t) for t in ("edges", "symbols", "files")))


@query("graph_flow_tree")
def flow_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first root of the call graph sets off."""
    e, s = table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols")
    start = G.roots(e, s).orderBy("name").first()
    return G.flow_tree(e, s, start["name"] if start else "")


@query("graph_neighbourhood", f"WITH {_SEED} SELECT DISTINCT e.source_name AS src, e.target_name AS dst, e.kind, e.confidence FROM edges e, seed WHERE e.source_name <> e.target_name AND (e.source_name = seed.name OR e.target_name = seed.name)")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in and out of the most referenced name."""
    e = table(spark, sf_dir, "edges")
    first = seed(e, table(spark, sf_dir, "symbols")).first()
    return G.neighbourhood(e, first["name"] if first else "")


_FIRST = "WITH c AS (SELECT name, arg_min_null(cluster_id, id) AS c FROM symbols GROUP BY name)"


@query("graph_constellation_nodes", "SELECT cluster_id, arg_min_null(name, id) AS representative, count(DISTINCT name) AS members FROM symbols WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def constellation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their representative."""
    return G.constellation(table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols"))[0]


@query("graph_constellation_links", _FIRST + " SELECT a.c AS from_cluster, b.c AS to_cluster, count(*) AS weight FROM (SELECT DISTINCT source_name, target_name FROM edges WHERE source_name <> target_name) e JOIN c a ON a.name = e.source_name JOIN c b ON b.name = e.target_name WHERE a.c <> b.c GROUP BY ALL")
def constellation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between clusters with their weight."""
    return G.constellation(table(spark, sf_dir, "edges"), table(spark, sf_dir, "symbols"))[1]
