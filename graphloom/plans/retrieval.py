"""Retrieval queries: the evaluation items' expected symbols against the symbol table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import ladder as L
from graphloom.operators import retrieval as R
from graphloom.plans import query
from graphloom.session import cut, table

_WORDS = """words AS (SELECT DISTINCT kind AS query_id, w AS term FROM (VALUES ('q1', 'cache'), ('q1', 'flush'), ('q2', 'merge'), ('q2', 'ledger'), ('q3', 'schema')) v(kind, w))"""
_TOK = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_COLS = (("name", 10.0), ("docstring", 2.0), ("signature", 2.0), ("search_text", 1.0))
_INDEX = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest({_TOK.format(c=c)}) AS term FROM symbols" for c, w in _COLS)
_BM25 = f"""
WITH {_WORDS}, tok AS ({_INDEX}), len AS (SELECT s.id, count(tok.id) AS len FROM symbols s LEFT JOIN tok ON tok.id = s.id GROUP BY s.id), n AS (SELECT count(*)::DOUBLE AS n FROM symbols), a AS (SELECT sum(len) / (SELECT n FROM n) AS avg FROM len),
hits AS (SELECT q.term AS q, t.id, sum(t.w) AS f FROM (SELECT DISTINCT term FROM words) q JOIN tok t ON starts_with(t.term, q.term) GROUP BY q.term, t.id), df AS (SELECT q, count(*) AS df FROM hits GROUP BY q),
s AS (SELECT h.q, h.id, greatest(ln((n.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * l.len / a.avg)) AS s FROM hits h JOIN df ON df.q = h.q JOIN len l ON l.id = h.id, n, a)
SELECT w.query_id, s.id, round(sum(s.s), 6) AS score FROM words w JOIN s ON s.q = w.term GROUP BY w.query_id, s.id
"""


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q1", "cache"), ("q1", "flush"), ("q2", "merge"), ("q2", "ledger"), ("q3", "schema")], "query_id string, term string")


@query("ret_bm25", _BM25)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with column weights and prefix terms over all symbols."""
    return L.keyword_scores(table(spark, sf_dir, "symbols"), _queries(spark))


_COS = """WITH ok AS (SELECT symbol_id AS id, vector AS vec FROM symbol_vectors WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.vec::DOUBLE[], v.vec::DOUBLE[]), 9) AS score FROM ok q JOIN ok v ON len(q.vec) = len(v.vec) WHERE q.id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


@query("ret_cosine_top_k", _COS)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 50, exact."""
    v = table(spark, sf_dir, "symbol_vectors").where(F.size("vector") == F.col("dim")).select(F.col("symbol_id").alias("id"), F.col("vector").alias("vec"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return R.cosine_top_k(v, q, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("ret_fuzzy", """WITH a AS (SELECT DISTINCT name AS query FROM symbols WHERE kind = 'class' AND name <> ''), b AS (SELECT DISTINCT target_name AS name FROM edges WHERE target_name <> '')
 SELECT query, name, damerau_levenshtein(query, name)::INT AS distance FROM a JOIN b ON abs(length(query) - length(name)) <= 1 WHERE damerau_levenshtein(query, name) <= 1""")
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge targets within one edit of a class's name."""
    names = table(spark, sf_dir, "edges").select(F.col("target_name").alias("name"))
    return R.fuzzy(names, table(spark, sf_dir, "symbols").where("kind = 'class'").select(F.col("name").alias("query")))


_SPLIT = r"""list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2))"""
_ASKED = r"""q AS (SELECT item_id AS query_id, text FROM eval_items WHERE text IS NOT NULL), tk AS (SELECT query_id, unnest(list_filter(string_split_regex(regexp_replace(text, '["''()*^+:{}\-]', ' ', 'g'), '\s+'), lambda x: x <> '' AND upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR'))) AS t FROM q),
 raw AS (SELECT query_id, list(lower(t)) AS t FROM tk GROUP BY query_id), words AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM tk UNION ALL SELECT query_id, unnest(""" + _SPLIT + """) FROM tk))"""
_RANKED = f"""tok AS ({_INDEX}), len AS (SELECT s.id, count(tok.id) AS len FROM symbols s LEFT JOIN tok ON tok.id = s.id GROUP BY s.id), n AS (SELECT count(*)::DOUBLE AS n, sum(len) / count(*) AS avg FROM len),
 m AS (SELECT q.term AS q, v.term FROM (SELECT DISTINCT term FROM words) q JOIN (SELECT DISTINCT term FROM tok) v ON starts_with(v.term, q.term)), hits AS (SELECT m.q, t.id, sum(t.w) AS f FROM m JOIN tok t ON t.term = m.term GROUP BY m.q, t.id), df AS (SELECT q, count(*) AS df FROM hits GROUP BY q),
 b AS (SELECT h.q, h.id, greatest(ln((n.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * len.len / n.avg)) AS s FROM hits h JOIN df ON df.q = h.q JOIN len ON len.id = h.id, n),
 k AS (SELECT w.query_id, b.id, round(sum(b.s), 6) AS score FROM words w JOIN b ON b.q = w.term GROUP BY w.query_id, b.id), lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= {{limit}}),
 fx AS (SELECT lx.*, lower(s.name) AS name, lower(f.path) AS path, lower(s.signature) AS signature, f.path AS p, s.cluster_id, first_value(s.cluster_id) OVER (PARTITION BY lx.query_id ORDER BY lx.rank) AS top, raw.t FROM lx JOIN symbols s ON s.id = lx.id JOIN files f ON f.id = s.file_id JOIN raw ON raw.query_id = lx.query_id),
 sc AS (SELECT query_id, id, rank AS before, round(score + CASE WHEN list_contains(t, name) THEN 80 WHEN len(list_filter(t, lambda x: starts_with(name, x))) > 0 THEN 40 ELSE 0 END + 10 * len(list_filter(t, lambda x: contains(path, x)))
  - CASE WHEN NOT list_has_any(t, ['test', 'tests', 'spec', 'fixture']) AND (list_has_any(list_slice(string_split(p, '/'), 1, -2), ['test', 'tests']) OR regexp_matches(lower(p), '(^|/)(conftest|test_[^/]*)\\.py$|_test\\.py$|\\.(spec|test)\\.[jt]sx?$')) THEN 30 ELSE 0 END
  + CASE WHEN top = cluster_id THEN 20 ELSE 0 END + 15 * coalesce(len(list_filter(t, lambda x: contains(signature, x))), 0), 6) AS score FROM fx),
 fin AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM sc)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text").where("text IS NOT NULL")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), _items(spark, sf_dir), 20)


_SEARCH = f"WITH {_ASKED}, {_RANKED.replace("{limit}", "20")}"


@query("ret_search", _SEARCH + " SELECT *, 'lexical' AS mode FROM fin")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all evaluation items searched by keyword and rescored; all of them share words with the index."""
    return _search(spark, sf_dir)


# near spellings of class names, none of which is a word of the index: one letter doubled at the end and the z of it before
_MISSPELT = "SELECT min(id) AS query_id, lower(name) || 'q' AS text FROM symbols WHERE kind = 'class' AND length(name) >= 5 GROUP BY lower(name)"


@query("ret_search_fallback", f"""WITH q AS ({_MISSPELT}), nm AS (SELECT lower(name) AS name, min(id) AS id FROM symbols WHERE name IS NOT NULL GROUP BY lower(name)),
 tok AS (SELECT DISTINCT term FROM ({_INDEX})), lex AS (SELECT query_id FROM q WHERE EXISTS (SELECT 1 FROM tok WHERE starts_with(tok.term, q.text))), lk AS (SELECT query_id FROM q WHERE EXISTS (SELECT 1 FROM nm WHERE contains(nm.name, q.text)))
 SELECT q.query_id, nm.id FROM q JOIN nm ON abs(length(nm.name) - length(q.text)) <= 1 AND damerau_levenshtein(nm.name, q.text) <= 1 WHERE q.query_id NOT IN (SELECT query_id FROM lex) AND q.query_id NOT IN (SELECT query_id FROM lk)""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names with a letter too many, found by spelling where neither keywords nor substrings find anything."""
    s = table(spark, sf_dir, "symbols")
    q = s.where("kind = 'class' AND length(name) >= 5").groupBy(F.lower("name").alias("n")).agg(F.min("id").alias("query_id")).select("query_id", F.concat("n", F.lit("q")).alias("text"))
    return L.search(s, table(spark, sf_dir, "files"), q, 1000).where("mode = 'keyword-fallback'").select("query_id", "id")


_NEAR = """ok AS (SELECT symbol_id AS id, model, vector AS vec FROM symbol_vectors WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 sem AS (SELECT query_id, id, rank FROM (SELECT a.id % 300 + 1 AS query_id, v.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec::DOUBLE[], v.vec::DOUBLE[]), 9) DESC, v.id) AS rank FROM ok a JOIN ok v ON len(a.vec) = len(v.vec) WHERE a.id IN (SELECT min(id) FROM ok WHERE id % 50 = 0 GROUP BY id % 300)) WHERE rank <= 10)"""


@query("ret_hybrid", _SEARCH + f""", {_NEAR}, nw AS (SELECT DISTINCT query_id FROM sem WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM lx) AND query_id IN (SELECT query_id FROM q)),
 un AS (SELECT query_id, id, rank, 0 AS l FROM lx WHERE query_id IN (SELECT query_id FROM nw) UNION ALL SELECT query_id, id, rank, 1 FROM sem WHERE query_id IN (SELECT query_id FROM nw)),
 g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s, min(CASE WHEN l = 0 THEN rank END) AS place, min(CASE WHEN l = 1 THEN rank END) AS far FROM un GROUP BY query_id, id),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place NULLS LAST, far NULLS LAST) AS rank FROM g)
 SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank, CASE WHEN place IS NOT NULL AND far IS NOT NULL THEN 'hybrid' WHEN far IS NOT NULL THEN 'semantic-only' ELSE 'lexical' END AS mode FROM h WHERE rank <= 20""")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lists of items fused with the neighbours of a vector each: of one usable vector for every sixth item."""
    v = table(spark, sf_dir, "symbol_vectors").where(F.size("vector") == F.col("dim")).select(F.col("symbol_id").alias("id"), F.col("vector").alias("vec"))
    usable = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    q = usable.where("id % 50 = 0").groupBy((F.col("id") % 300 + 1).alias("query_id")).agg(F.min_by("vec", "id").alias("vec"))
    near = R.cosine_top_k(usable, q.join(_items(spark, sf_dir), "query_id", "left_semi"), 10)
    found = L.search(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), _items(spark, sf_dir), 20, near)
    return found.join(near.select("query_id").distinct(), "query_id", "left_semi")


@query("ret_rrf", _SEARCH + """ SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM lx UNION ALL SELECT query_id, id, rank FROM fin) GROUP BY query_id, id""")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order by keywords and the rescored order of every item fused by reciprocal ranks."""
    s, f, q = table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), _items(spark, sf_dir)
    lexical = cut(R.top_k(L.keyword_scores(s, q.select("query_id", F.explode(L.query_terms(F.col("text"))).alias("term"))), 20))
    return R.rrf([lexical, L.rescored(lexical, q, s, f)]).withColumn("score", F.round("score", 9))


@query("ret_query", f"""WITH {_ASKED}, {_RANKED.replace("{limit}", "10")}, sd AS (SELECT fin.query_id, s.name, max(fin.score) AS score FROM fin JOIN symbols s ON s.id = fin.id WHERE s.name IS NOT NULL GROUP BY ALL), c AS (SELECT name, arg_min_null(kind, id) AS kind FROM symbols WHERE name <> '' GROUP BY name),
 mb AS (SELECT DISTINCT split_part(name, '.', 1) AS owner, list_last(string_split(name, '.')) AS bare FROM symbols WHERE name LIKE '%.%'),
 al AS (SELECT name, name AS match FROM c UNION SELECT name, list_last(string_split(name, '.')) FROM c WHERE name LIKE '%.%' AND name NOT LIKE '%.' UNION SELECT c.name, bare FROM c JOIN mb ON mb.owner = c.name WHERE c.kind IN ('class', 'interface', 'struct') AND c.name NOT LIKE '%.%' AND bare <> ''),
 aj AS (SELECT DISTINCT source_name AS src, target_name AS dst FROM edges WHERE source_name <> target_name), lk AS (SELECT DISTINCT sd.query_id, al.match FROM sd JOIN al ON al.name = sd.name),
 nb AS (SELECT query_id, src AS name FROM aj JOIN lk ON lk.match = aj.dst UNION SELECT query_id, dst FROM aj JOIN lk ON lk.match = aj.src UNION SELECT query_id, dst FROM aj JOIN lk ON lk.match = aj.dst UNION SELECT query_id, src FROM aj JOIN lk ON lk.match = aj.src),
 ev AS (SELECT query_id, name, score, true AS seed FROM sd UNION ALL SELECT query_id, name, 0.0, false FROM nb WHERE name IN (SELECT name FROM symbols) AND (query_id, name) NOT IN (SELECT (query_id, name) FROM sd)),
 pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed DESC, score DESC, name) AS rank FROM ev) WHERE rank <= 10),
 ci AS (SELECT al.name, count(DISTINCT aj.src) AS n FROM al JOIN aj ON aj.dst = al.match GROUP BY al.name), co AS (SELECT al.name, count(DISTINCT aj.dst) AS n FROM al JOIN aj ON aj.src = al.match GROUP BY al.name)
 SELECT pg.query_id, pg.name, pg.score, pg.seed, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees, pg.rank FROM pg LEFT JOIN ci ON ci.name = pg.name LEFT JOIN co ON co.name = pg.name""")
def concept_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluation items as concept queries: seeds, neighbours and how connected they are."""
    return L.concept(*(table(spark, sf_dir, t) for t in ("symbols", "files", "edges")), _items(spark, sf_dir))


_METRICS = _SEARCH + """, ex AS (SELECT DISTINCT item_id AS query_id, unnest(expected_symbols) AS name FROM eval_items), rk AS (SELECT fin.query_id, s.name, min(fin.rank) AS rank FROM fin JOIN symbols s ON s.id = fin.id GROUP BY ALL),
 mt AS (SELECT ex.query_id, count(CASE WHEN rk.rank <= 10 THEN 1 END)::DOUBLE / count(*) AS recall, coalesce(1.0::DOUBLE / min(rk.rank), 0) AS reciprocal FROM ex LEFT JOIN rk ON rk.query_id = ex.query_id AND rk.name = ex.name WHERE ex.name IS NOT NULL GROUP BY ex.query_id)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _search(spark, sf_dir).join(table(spark, sf_dir, "symbols").select("id", "name"), "id").select("query_id", "name", "rank")
    expected = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.explode("expected_symbols").alias("name")).where("name IS NOT NULL")
    return L.metrics(ranked, expected)


@query("ret_recall_at_k", _METRICS + " SELECT query_id, round(recall, 6) AS recall FROM mt")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each item's expected symbols among the first ten that the search for its text finds."""
    return _metrics(spark, sf_dir).select("query_id", F.round("recall", 6).alias("recall"))


@query("ret_mrr", _METRICS + " SELECT query_id, round(reciprocal, 6) AS reciprocal FROM mt")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One over the rank of the first expected symbol of each item."""
    return _metrics(spark, sf_dir).select("query_id", F.round("reciprocal", 6).alias("reciprocal"))


@query("ret_metrics", _METRICS + " SELECT count(*) AS queries, round(avg(recall), 6) AS recall_at_10, round(avg(reciprocal), 6) AS mrr FROM mt")
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both measures, averaged over the items."""
    m = _metrics(spark, sf_dir)
    return m.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("recall_at_10"), F.round(F.avg("reciprocal"), 6).alias("mrr"))


@query("ret_overlap", _SEARCH + " SELECT a.query_id, round(count(b.id)::DOUBLE / count(*), 6) AS overlap FROM lx a LEFT JOIN fin b ON b.query_id = a.query_id AND b.id = a.id AND b.rank <= 10 WHERE a.rank <= 10 GROUP BY a.query_id")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the first ten by keywords stays among the first ten after rescoring."""
    s, f, q = table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), _items(spark, sf_dir)
    lexical = cut(R.top_k(L.keyword_scores(s, q.select("query_id", F.explode(L.query_terms(F.col("text"))).alias("term"))), 20))
    after = L.rescored(lexical, q, s, f).where("rank <= 10").select("query_id", "id", F.lit(1).alias("kept"))
    return lexical.where("rank <= 10").join(after, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("kept") / F.count(F.lit(1)), 6).alias("overlap"))
