"""Structural search: symbols by their properties and by the degrees that filtered edges give them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import glob_to_regex, is_test_path_narrow, uid

# ---- fixed values: the vocabularies of the index -------------------------------------------------------------------
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "field", "route", "config", "resource")
EDGE_KINDS = (
    "call", "import", "extends", "implements", "instantiates", "holds", "reads", "writes", "uses", "http_calls", "reads_config", "configures",
    "raises", "catches", "tests",
)
SORTS = ("default", "in-degree", "out-degree", "total-degree", "name", "file", "line")
EXACT_RECEIVERS = ("python-receiver-type", "typescript-receiver-type", "javascript-receiver-type")
MAX_LIMIT, MAX_PREVIEW = 100, 10
#: presets: values that hold where the caller gave none
PRESETS = {
    "dead-code": {"edge_kind": "call", "direction": "incoming", "max_in_degree": 0},
    "hotspot": {"direction": "incoming", "min_in_degree": 2, "sort": "in-degree"},
    "field-access": {"edge_kind": "reads,writes", "direction": "both"},
    "inheritance": {"edge_kind": "extends,implements", "direction": "both"},
    "isolates": {"direction": "both", "max_degree": 0},
}
#: recipes: named sets of parameters, for which a caller's own values go first
RECIPES = {
    "production-hotspots": {"preset": "hotspot", "test_scope": "source", "sort": "in-degree"},
    "fan-out-orchestrators": {"direction": "outgoing", "min_out_degree": 2, "sort": "out-degree", "test_scope": "source"},
    "dead-code-suspects": {"kind": "function", "preset": "dead-code", "test_scope": "source", "sort": "name"},
    "isolated-symbols": {"preset": "isolates", "test_scope": "source", "sort": "name"},
    "field-access": {"kind": "field", "preset": "field-access", "include_preview": True},
    "inheritance-families": {"preset": "inheritance", "include_preview": True},
    "route-entrypoints": {"kind": "route", "sort": "name"},
    "http-callers": {"edge_kind": "http_calls", "direction": "outgoing", "include_preview": True},
    "config-readers": {"kind": "config", "edge_kind": "reads_config", "direction": "incoming", "include_preview": True},
    "resource-config-links": {"kind": "resource", "edge_kind": "configures", "direction": "incoming", "include_preview": True},
    "test-evidence": {"edge_kind": "tests", "direction": "incoming", "include_preview": True, "test_scope": "source"},
    "exception-flow": {"edge_kind": "raises,catches", "direction": "outgoing", "include_preview": True},
    "path-structure": {"sort": "file"},
    "class-family": {"kind": "class", "sort": "name"},
    "function-family": {"kind": "function", "sort": "name"},
}
# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Search:
    """What to search for; None asks for nothing."""

    kind: str | None = None
    name_pattern: str | None = None
    qualified_name_pattern: str | None = None
    file_pattern: str | None = None
    language: str | None = None
    edge_kind: str | None = None
    direction: str = "both"
    min_degree: int | None = None
    max_degree: int | None = None
    min_in_degree: int | None = None
    max_in_degree: int | None = None
    min_out_degree: int | None = None
    max_out_degree: int | None = None
    confidence: str | None = None
    synthesized: str = "any"
    cluster_id: int | None = None
    visibility: str | None = None
    is_exported: bool | None = None
    test_scope: str = "any"
    preset: str | None = None
    sort: str = "default"
    limit: int = 20
    offset: int = 0
    include_preview: bool = False
    preview_limit: int = 3
    regex: bool = False

    @property
    def edge_kinds(self) -> list[str] | None:
        kinds = [x.strip() for x in (self.edge_kind or "").split(",") if x.strip()]
        return kinds or None

    def checked(self) -> Search:
        """The search with its preset filled in; a ValueError names what is not known or negative."""
        for name, known in (
            ("kind", (*SYMBOL_KINDS, None)), ("direction", ("incoming", "outgoing", "both")), ("confidence", ("EXTRACTED", "INFERRED", "AMBIGUOUS", None)),
            ("synthesized", ("any", "parser", "synthesized")), ("test_scope", ("any", "test", "source")), ("preset", (*PRESETS, None)), ("sort", SORTS),
        ):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int) and not isinstance(v, bool) and f.name != "cluster_id" and v < 0:
                raise ValueError(f"{f.name} is negative")
        plain = Search()
        fill = {k: v for k, v in PRESETS.get(self.preset or "", {}).items() if k == "direction" or getattr(self, k) == getattr(plain, k)}
        out = replace(self, **fill)
        if odd := sorted({*(out.edge_kinds or ())} - {*EDGE_KINDS}):
            raise ValueError(f"unknown edge kind: {odd[0]}")
        return out


def recipe(name: str, **own: object) -> Search:
    """The search of a recipe; values that differ from the plain defaults go before the recipe's."""
    plain = Search()
    return Search(**{**RECIPES[name], **{k: v for k, v in own.items() if v != getattr(plain, k)}})


def matches(c: Column, pattern: str | None, regex: bool) -> Column:
    """Whether a value fits a shell pattern, or holds a regular expression; null fits none, no pattern is fit by all."""
    if not pattern:
        return F.lit(True)
    return F.coalesce(c.rlike(pattern if regex else glob_to_regex(pattern)), F.lit(False))


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is in the scope: any, test or source."""
    t = is_test_path_narrow(path)
    return F.lit(True) if scope == "any" else t if scope == "test" else ~t


def indexed(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The symbols of files that are none of the index's own, with path, language and uid."""
    f = files.where("path NOT LIKE ':%'").select(F.col("id").alias("file_id"), "path", "language")
    return symbols.join(f, "file_id").withColumn("uid", uid(F.col("path"), F.col("start_line")))


def receiver_confidence(edges: DataFrame, symbols: DataFrame, scope: str = "any") -> DataFrame:
    """Edges whose calls with an exactly known receiver are EXTRACTED if one symbol (of the scope) bears the target's name,
    AMBIGUOUS if several do; all others stay as they are."""
    counts = symbols.where(in_scope(F.col("path"), scope)).groupBy(F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("_n"))
    exact = (F.col("kind") == "call") & F.col("provenance").isin(*EXACT_RECEIVERS)
    better = F.when(exact & (F.col("_n") == 1), "EXTRACTED").when(exact & (F.col("_n") > 1), "AMBIGUOUS").otherwise(F.col("confidence"))
    return edges.join(counts, "target_name", "left").withColumn("confidence", better).drop("_n")


def edge_filter(s: Search) -> Column:
    """The condition on edges of a search."""
    out = F.col("kind").isin(s.edge_kinds) if s.edge_kinds else F.lit(True)
    if s.confidence:
        out = out & (F.col("confidence") == s.confidence)
    if s.synthesized != "any":
        out = out & (F.col("synthesized_by").isNull() if s.synthesized == "parser" else F.col("synthesized_by").isNotNull())
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(name, incoming, outgoing) of the names at the ends of edges; counted per end before the two are put together."""
    into = edges.groupBy(F.col("target_name").alias("name")).agg(F.count(F.lit(1)).alias("incoming"))
    out = edges.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("outgoing"))
    zero = F.lit(0).cast("long")
    both = into.withColumn("outgoing", zero).unionByName(out.withColumn("incoming", zero))
    return both.groupBy("name").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def graph_search(symbols: DataFrame, edges: DataFrame, files: DataFrame, search: Search) -> DataFrame:
    """One page of rows (id, symbol, kind, path, line, uid, visibility, cluster_id, incoming, outgoing, degree, total), and with
    ``include_preview`` ``preview``: the first connected names with direction, kind of edge and confidence.

    ``total`` counts all that fit, the page has at most 100 of them. An edge filter without a bound on degrees asks for a
    degree of at least one in the direction asked for. A null name fits no pattern and has no edges.
    """
    s = search.checked()
    rows = indexed(symbols, files)
    kept = receiver_confidence(edges.where("source_name IS NOT NULL OR target_name IS NOT NULL"), rows, s.test_scope).where(edge_filter(s))
    per = degrees(kept)
    found = rows.where(in_scope(F.col("path"), s.test_scope))
    for c, v in (("kind", s.kind), ("language", s.language), ("cluster_id", s.cluster_id), ("visibility", s.visibility), ("is_exported", s.is_exported)):
        if v is not None:
            found = found.where(F.col(c) == v)
    for c, p in (("name", s.name_pattern), ("qualified_name", s.qualified_name_pattern), ("path", s.file_pattern)):
        found = found.where(matches(F.col(c), p, s.regex))
    found = found.join(per, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("incoming", "outgoing")})
    found = found.withColumn("degree", F.col("incoming") + F.col("outgoing"))
    bounds = ((s.min_degree, s.max_degree, "degree"), (s.min_in_degree, s.max_in_degree, "incoming"), (s.min_out_degree, s.max_out_degree, "outgoing"))
    for least, most, c in bounds:
        if least is not None:
            found = found.where(F.col(c) >= least)
        if most is not None:
            found = found.where(F.col(c) <= most)
    filtered = s.edge_kinds or s.confidence or s.synthesized != "any"
    if filtered and all(least is None and most is None for least, most, _ in bounds):
        found = found.where(F.col({"incoming": "incoming", "outgoing": "outgoing"}.get(s.direction, "degree")) > 0)
    found = found.select(
        "id", F.col("name").alias("symbol"), "kind", "path", F.col("start_line").alias("line"), "uid", "visibility", "cluster_id", "incoming", "outgoing", "degree"
    )
    first = {"in-degree": [F.desc("incoming")], "out-degree": [F.desc("outgoing")], "total-degree": [F.desc("degree")]}.get(s.sort, [])
    then = {"file": ["path", "line", "symbol"], "line": ["line", "symbol", "path"]}.get(s.sort, ["symbol", "path", "line"])
    page = found.orderBy(*first, *then, "id").offset(s.offset).limit(min(s.limit, MAX_LIMIT))
    page = page.withColumn("total", found.agg(F.count(F.lit(1)).alias("n")).scalar())
    return page.join(previews(page, kept, s), "id", "left") if s.include_preview else page


def previews(page: DataFrame, edges: DataFrame, s: Search) -> DataFrame:
    """(id, preview, preview_more): the first edges of each row of a page, by direction, kind, source and target."""
    edges, wanted = edges.drop("id"), F.broadcast(page.select("id", F.col("symbol").alias("name")))  # at most a page of rows
    cols = ["kind", "source_name", "target_name", "confidence", "receiver", "synthesized_by", "provenance"]
    sides = []
    if s.direction in ("incoming", "both"):
        sides.append(edges.join(wanted, edges["target_name"] == wanted["name"]).select("id", F.lit("incoming").alias("direction"), F.col("source_name").alias("other"), *cols))
    if s.direction in ("outgoing", "both"):
        sides.append(edges.join(wanted, edges["source_name"] == wanted["name"]).select("id", F.lit("outgoing").alias("direction"), F.col("target_name").alias("other"), *cols))
    every = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    most = min(s.preview_limit, MAX_PREVIEW)
    order = Window.partitionBy("id").orderBy("direction", "kind", "source_name", "target_name", F.coalesce("confidence", F.lit("")))
    top = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1)  # one more tells that there are more
    one = F.struct("r", "direction", "other", F.col("kind").alias("edge_kind"), "confidence")
    listed = top.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    shown = F.transform(F.slice("p", 1, max(1, most)), lambda x: F.concat_ws(" ", x["direction"], x["edge_kind"], x["other"]))
    return listed.select("id", shown.alias("preview"), (F.size("p") > most).alias("preview_more"))
