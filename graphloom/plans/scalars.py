"""Queries of the scalar functions, over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.plans import query
from graphloom.session import table


@query(
    "fn_split_identifier",
    r"""
    SELECT id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words_all,
           len(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')))::BIGINT AS n_words
    FROM symbols
    """,
)
def split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols")
    apart = F.regexp_replace(F.regexp_replace("name", r"([a-z0-9])([A-Z])", r"$1 $2"), r"([A-Z]+)([A-Z][a-z])", r"$1 $2")
    every = F.array_join(F.filter(F.split(F.lower(apart), r"[^a-z0-9]+"), lambda x: x != ""), " ")
    return s.select("id", every.alias("words_all"), F.size(T.split_identifier(F.col("name"))).cast("long").alias("n_words"))


@query("fn_uid", "SELECT s.id, substring(sha1(f.path), 1, 8) || ':' || s.start_line AS uid FROM symbols s JOIN files f ON f.id = s.file_id")
def uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path")
    return table(spark, sf_dir, "symbols").join(f, "file_id").select("id", T.uid(F.col("path"), F.col("start_line")).alias("uid"))


@query("fn_bare_owner", r"SELECT id, regexp_extract(name, '([^.]*)$', 1) AS bare, nullif(regexp_extract(name, '^(.*)\.[^.]*$', 1), '') AS owner FROM symbols")
def bare_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("id", T.bare_name(F.col("name")).alias("bare"), T.owner_name(F.col("name")).alias("owner"))


@query(
    "fn_test_path",
    r"""
    SELECT id, (list_has_any(list_slice(string_split(path, '/'), 1, -2), ['test', 'tests']) OR regexp_matches(lower(path), '(^|/)(conftest|test_[^/]*)\.py$|_test\.py$')
             OR regexp_matches(lower(path), '\.(spec|test)\.(js|jsx|ts|tsx)$')) AS is_test,
           (contains('/' || lower(path), '/test/') OR contains('/' || lower(path), '/tests/') OR lower(path) LIKE '%\_test.py' ESCAPE '\' OR regexp_matches(lower(path), '\.(test|spec)\.(ts|js)$')) AS is_test_narrow FROM files
    """,
)
def test_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "files").select("id", T.is_test_path(p).alias("is_test"), T.is_test_path_narrow(p).alias("is_test_narrow"))


@query("fn_slug", r"SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE title IS NOT NULL")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("title IS NOT NULL").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query("fn_config_key", r"SELECT id, upper(regexp_replace(regexp_replace(trim(name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS config_key FROM symbols")
def config_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("id", T.normal_key(F.col("name")).alias("config_key"))


@query("fn_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("fn_route_normalise", r"""
    WITH r AS (SELECT id, regexp_replace(regexp_replace('/' || trim(path), '(:[A-Za-z_]\w*|<[^>]+>|\{[^}]+\}|\$\{[^}]+\})', '{param}', 'g'), '/+', '/', 'g') AS r FROM files)
    SELECT id, CASE WHEN length(r) > 1 THEN regexp_replace(r, '/$', '') ELSE r END AS route FROM r
    """)
def route_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", T.normal_route(F.col("path")).alias("route"))


@query("fn_value_category", r"""
    SELECT call_id, k AS arg, CASE WHEN v IS NULL THEN NULL WHEN t = '' THEN 'empty' WHEN t IN ('true','false','yes','no','on','off') THEN 'boolean' WHEN regexp_matches(t, '^-?\d+(\.\d+)?$') THEN 'number'
      WHEN regexp_matches(t, '^[a-z][a-z0-9+.-]*://') THEN 'url' WHEN regexp_matches(t, '^<.*>$|^\$\{.*\}$|^(changeme|todo|xxx|your[_-].*)$') THEN 'placeholder' ELSE 'present' END AS category
    FROM (SELECT call_id, e.key AS k, e.value AS v, lower(trim(e.value)) AS t FROM (SELECT call_id, unnest(map_entries(args)) AS e FROM tool_calls))
    """)
def value_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tool_calls").select("call_id", F.explode("args").alias("arg", "v"))
    return rows.select("call_id", "arg", T.value_category(F.col("v")).alias("category"))


@query("fn_glob", r"SELECT id FROM files WHERE path GLOB '*/src/*.py'")
def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(F.col("path").rlike(T.glob_to_regex("*/src/*.py"))).select("id")
