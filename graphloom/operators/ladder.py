"""Search as a user calls it, for many queries at once: keywords, then substrings, then near spellings, fused with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_path, split_identifier
from graphloom.operators.graph import adjacency, aliases, sized
from graphloom.operators.retrieval import B, K1, RRF_K, WEIGHTS, fuzzy, rrf, terms, top_k
from graphloom.session import cut

# ---- fixed values: what a row gains beside its keyword score -------------------------------------------------------
EXACT_NAME, NAME_PREFIX, PATH_TERM, TEST_FILE, SAME_CLUSTER, SIGNATURE_TERM, COHESION = 80.0, 40.0, 10.0, -30.0, 20.0, 15.0, 0.1
TEST_WORDS = ("test", "tests", "spec", "fixture")
OPERATORS = ("AND", "OR", "NOT", "NEAR")
SPECIAL = r"[\"'()*^+:{}\-]"
SEMANTIC_SEED = 0.5
# ---------------------------------------------------------------------------------------------------------------------


def query_tokens(text: Column) -> Column:
    """The words of a query as written, without special signs and operators."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPECIAL, " "), r"\s+"), lambda x: (x != "") & ~F.upper(x).isin(*OPERATORS))


def query_terms(text: Column) -> Column:
    """What a query is looked up by: its words as the index cuts them, and the parts of identifiers of two letters or more."""
    words = F.flatten(F.transform(query_tokens(text), lambda t: F.concat(terms(t), F.filter(split_identifier(t), lambda x: F.length(x) >= 2))))
    return F.array_distinct(words)


def keyword_scores(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): BM25 of all rows that hold a term of the query as a prefix; ``queries`` is (query_id, term).

    Lengths are sizes of arrays and need no shuffle; the vocabulary is matched to the queries' terms first, and only tokens
    that match are grouped. A prefix has one document frequency; the idf is floored at 1e-6.
    """
    per = [F.struct(terms(F.coalesce(F.col(c), F.lit(""))).alias("t"), F.lit(w).alias("w")) for c, w in WEIGHTS.items()]
    rows = symbols.select("id", F.array(*per).alias("p")).withColumn("len", F.aggregate("p", F.lit(0), lambda s, x: s + F.size(x["t"])))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.count(F.lit(1))).alias("avg"))
    tokens = rows.select("id", "len", F.explode("p").alias("p")).select("id", "len", F.col("p.w").alias("w"), F.explode("p.t").alias("term"))
    wanted = queries.select("query_id", F.lower("term").alias("q")).where("q <> ''").distinct()
    heads = tokens.select("term").distinct().select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("q"))
    matched, _ = sized(cut(heads.join(wanted.select("q").distinct(), "q")))
    hits = tokens.join(matched, "term").groupBy("q", "id").agg(F.sum("w").alias("f"), F.first("len").alias("len"))
    df = hits.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    n, avg = stats.first() or (0, 1.0)
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(float(avg or 1.0))))
    scored = hits.join(F.broadcast(df) if matched.count() else df, "q").select("q", "id", part.alias("s"))  # df has at most a row a query term
    return wanted.join(scored, "q").groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))


def rescored(rows: DataFrame, queries: DataFrame, symbols: DataFrame, files: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): rows (query_id, id, score, rank) with what name, path, cluster, signature and tests speak for.

    The cluster that counts is that of a query's first row. A name that is a term gains more than one that begins with
    one; test files lose unless the query asks for tests. Of equal scores the former order stays.
    """
    words = queries.select("query_id", F.transform(query_tokens(F.col("text")), lambda x: F.lower(x)).alias("t"))
    facts = symbols.select("id", "name", "signature", "cluster_id", "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    few, _ = sized(rows)
    r = facts.join(few, "id").join(words, "query_id")
    if clusters is not None:
        r = r.join(F.broadcast(clusters.select("cluster_id", "cohesion")) if clusters.count() <= 100_000 else clusters.select("cluster_id", "cohesion"), "cluster_id", "left")
    else:
        r = r.withColumn("cohesion", F.lit(None).cast("double"))
    top = F.first("cluster_id").over(Window.partitionBy("query_id").orderBy("rank"))
    name, path, signature = F.lower("name"), F.lower("path"), F.lower("signature")
    count = lambda c, x: F.coalesce(F.size(F.filter("t", lambda t: F.coalesce(c.contains(t), F.lit(False)))), F.lit(0)) * x
    bonus = (
        F.when(F.array_contains("t", name), EXACT_NAME).when(F.exists("t", lambda t: name.startswith(t)), NAME_PREFIX).otherwise(0.0)
        + count(path, PATH_TERM) + F.when(~F.arrays_overlap("t", F.array(*map(F.lit, TEST_WORDS))) & is_test_path(F.col("path")), TEST_FILE).otherwise(0.0)
        + F.when(top == F.col("cluster_id"), SAME_CLUSTER).otherwise(0.0) + count(signature, SIGNATURE_TERM) + F.coalesce("cohesion", F.lit(0.0)) * COHESION
    )
    new = r.withColumn("bonus", bonus).select("query_id", "id", F.round(F.col("score") + F.col("bonus"), 6).alias("score"), F.col("rank").alias("before"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return new.withColumn("rank", F.row_number().over(order)).drop("before")


def by_substring(symbols: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): symbols whose name holds a word of the query, case aside, first by word, then by id.

    ``words`` is (query_id, word): a stated set, held as one array against which every name is looked at once.
    """
    held = [r["word"] for r in words.select(F.lower("word").alias("word")).where("word <> ''").distinct().limit(10_001).collect()]
    if len(held) > 10_000:
        raise ValueError("more than 10,000 words: search in blocks")
    spark = symbols.sparkSession
    if not held:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    low = F.lower("name")
    found = symbols.where("name IS NOT NULL").select("id", "name", F.explode(F.filter(F.array(*map(F.lit, held)), lambda w: low.contains(w))).alias("word"))
    asked = words.select("query_id", F.lower("word").alias("word"), "place")
    hits = found.join(F.broadcast(asked), "word").groupBy("query_id", "name").agg(F.min(F.struct("place", "id")).alias("p"))
    order = Window.partitionBy("query_id").orderBy("p.place", "p.id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", F.col("p.id").alias("id"), F.lit(0.0).alias("score"), "rank")


def by_spelling(symbols: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): symbols whose name is within one edit of a word of three letters or more, by distance and name."""
    asked = words.where(F.length("word") >= 3).select("query_id", F.lower("word").alias("query")).distinct()
    names = symbols.where("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    hits = fuzzy(names, asked, 1).join(names, "name").join(asked, "query").groupBy("query_id", "id", "name").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "name")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", F.lit(0.0).alias("score"), "rank")


def search(symbols: DataFrame, files: DataFrame, queries: DataFrame, limit: int = 20, semantic: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, mode) of (query_id, text) queries, at most ``limit`` a query.

    Keywords come first. Where ``semantic`` candidates (query_id, id, rank) bring an id that keywords did not, both lists are
    fused and the score is 1 / (60 + rank), mode hybrid, semantic-only or lexical. Queries that keywords find nothing for
    are searched by substring, then by spelling, mode keyword-fallback. Queries without a word give no rows.
    """
    asked = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    lexical = cut(top_k(keyword_scores(symbols, asked), limit))
    found = rescored(lexical, queries, symbols, files, clusters).withColumn("mode", F.lit("lexical"))
    words = queries.select("query_id", F.posexplode(query_tokens(F.col("text"))).alias("place", "word"))
    missed = cut(words.join(lexical.select("query_id").distinct(), "query_id", "left_anti"))
    out = found
    if not missed.isEmpty():
        like = cut(by_substring(symbols, missed, limit))
        near = by_spelling(symbols, missed.join(like.select("query_id").distinct(), "query_id", "left_anti"), limit)
        fallback = rescored(cut(like.unionByName(near)), queries, symbols, files, clusters)
        out = out.unionByName(fallback.withColumn("mode", F.lit("keyword-fallback")))
    if semantic is None:
        return out
    sem = cut(semantic.select("query_id", "id", F.col("rank").cast("int").alias("rank")))
    new = sem.join(lexical.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id").distinct()
    lists = [x.join(new, "query_id", "left_semi") for x in (lexical.select("query_id", "id", "rank"), sem)]
    # of equal sums the keyword list goes first, in its order, as it was put in first
    own = lists[0].select("query_id", "id", F.col("rank").alias("place"))
    other = lists[1].select("query_id", "id", F.col("rank").alias("far"))
    merged = rrf(lists).withColumn("score", F.round("score", 12)).join(own, ["query_id", "id"], "left").join(other, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("place").asc_nulls_last(), F.col("far").asc_nulls_last())
    mode = F.when(F.col("place").isNotNull() & F.col("far").isNotNull(), "hybrid").when(F.col("far").isNotNull(), "semantic-only").otherwise("lexical")
    fused = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    fused = fused.select("query_id", "id", F.round(1.0 / (RRF_K + F.col("rank")), 9).alias("score"), "rank", mode.alias("mode"))
    return out.join(new, "query_id", "left_anti").unionByName(fused)


def concept(symbols: DataFrame, files: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, name, score, seed, callers, callees, rank): keyword seeds by name, their neighbours of one hop with score 0,
    seeds first, then by score and name; of homonyms the best row counts. Callers and callees are counted over a name's
    other names too."""
    asked = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    ranked = rescored(cut(top_k(keyword_scores(symbols, asked), limit)), queries, symbols, files)
    names = symbols.where("name IS NOT NULL").select("id", "name")
    seeds = cut(ranked.join(names, "id").groupBy("query_id", "name").agg(F.max("score").alias("score")))
    also = cut(aliases(symbols, seeds))
    adj = adjacency(edges).select("src", "dst").distinct()
    links, _ = sized(cut(seeds.select("query_id", "name").join(also, "name").select("query_id", F.col("match").alias("m")).distinct()))
    near = adj.join(links, adj["dst"] == links["m"]).select("query_id", F.explode(F.array("src", "dst")).alias("name"))
    far = adj.join(links, adj["src"] == links["m"]).select("query_id", F.explode(F.array("src", "dst")).alias("name"))
    beside = near.union(far).distinct().join(names.select("name").distinct(), "name", "left_semi").join(seeds.select("query_id", "name"), ["query_id", "name"], "left_anti")
    every = seeds.withColumn("seed", F.lit(True)).unionByName(beside.select("query_id", "name", F.lit(0.0).alias("score"), F.lit(False).alias("seed")))
    order = Window.partitionBy("query_id").orderBy(F.desc("seed"), F.desc("score"), "name")
    page = cut(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    match, _ = sized(cut(aliases(symbols, page)))
    callers = adj.join(match, adj["dst"] == match["match"]).groupBy("name").agg(F.countDistinct("src").alias("callers"))
    callees = adj.join(match, adj["src"] == match["match"]).groupBy("name").agg(F.countDistinct("dst").alias("callees"))
    out = page.join(callers, "name", "left").join(callees, "name", "left")
    return out.select("query_id", "name", "score", "seed", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), "rank")


def metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal): of rankings (query_id, name, rank) the share of the expected names (query_id, name) among
    the first ``k``, and one over the first rank that holds one, 0 where none does. Queries that expect nothing are left out."""
    best = ranked.groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    hit = expected.select("query_id", "name").distinct().join(best, ["query_id", "name"], "left")
    per = hit.groupBy("query_id").agg((F.count(F.when(F.col("rank") <= k, 1)) / F.count(F.lit(1))).alias("recall"), F.min("rank").alias("first"))
    return per.select("query_id", "recall", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal"))
