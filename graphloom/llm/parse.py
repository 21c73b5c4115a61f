"""Source files that do not parse in their language.

Every text is lexed into rows, one a token. A file is flagged where two adjacent tokens are no pair that its language's
grammar permits (an anti-join with the pairs derived from the grammar, a table of fixed size), where brackets do not
nest (running sums, and at each depth every closing bracket must meet its opening one), or where a statement has no
production (the shapes of whole statements, gathered by windows). Python files so flagged are then parsed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.grammar import GRAMMARS, lex, permitted
from graphloom.llm.registry import shared_dir

#: shapes of statements for which there is no production, by language: a pattern over token classes, and where it holds
#: (``top``: outside of all brackets, ``end``: at the end of the file, ``any``)
NO_PRODUCTION = (
    ("c java rust go", "any", r"(^| )ID ID ID( |$)"),
    ("c java rust", "end", r"\S"),
    ("javascript typescript", "end", r"(^| )(FUNC|CLASS|TRY|FIN|CATCH|DO|ELSE)( |$)|^(EXP )?IMP (?!(.* )?STR$|LP |DOT )|^EXP$|^(EXP )?MOD ID$|^(EXP )?MOD (MOD|FUNC|VAR)( ID)?$|^IF LP((?!RP).)*$|^IF LP [^;]*RP$"),
    ("javascript typescript", "any", r"^IMP ID( (?!(MOD|COMMA|EQ) ).*)?$"),
    # what only TypeScript has: a colon in round brackets without a question mark before it, types of variables and results,
    # type parameters, types of arrays, assertions, and exports of declarations that are none
    ("javascript", "any", r"(^| )LP ((?!LP |RP |Q |LC |CASE )\S+ )*COLON( |$)|(^| )VAR ID COLON( |$)|(^| )(CLASS|FUNC) ID LT( |$)|(^| )ID LB RB( |$)|^EXP ID( |$)"),
    ("javascript", "any", r"^(?!(.* )?(Q|CASE) ).*RP COLON (ID|UNK)( DOT ID)*( LT .*GT)?( LB RB)* (LC|ARROW)( |$)"),
    ("javascript", "any", r"^(?!IMP |EXP |(?:(?:ID|STR|DEF|MOD|AS)(?: AS (?:ID|STR|DEF|MOD|AS))?(?: COMMA)? )+RC( |$))(.* )?(ID|NUM|STR|RP|RB|RC) AS (ID|STR|UNK|LC|LB|VAR)( |$)"),
    ("java", "top", r"^(?!ANN( |$)|MODS( |$)|CLASS |ENUM |PKG |IMP |ID ID (LP|LT) |ID CLASS |SEMI$|RC$|EOF$).+"),
    ("go", "top", r"^(?!PKG |IMP |FUNC |TYPE |VAR |SEMI$|RC$|LC( |$)|LP |RP |DOT |COMMA ).+|^FUNC (LP [^;]* RP )?ID( LB .* RB)? SEMI$"),
    ("c", "top", r"^(?!TY( |$)|STRUCT( |$)|TYPEDEF |ID( |$)|STAR |COMMA |EQ |LP |SEMI$|RC( |$)|STR ).+"),
    ("rust", "top", r"^(?!HASH |PUB |USE |MOD |FN |STRUCT |IMPL |TRAIT |TYPE |CONST |STATIC |EXTERN |UNSAFE |ASYNC |ID NOT |SEMI$|RC$|WHERE |COMMA ).+"),
    ("python", "any", r"^(DEF|CLASS|IF|WHILE|FOR|WITH|TRY|EXCEPT|FIN|ELSE)( (?!COLON( |$))\S+)*$"),
)


def tokens(texts: DataFrame) -> DataFrame:
    """Rows (id, language, t): the token classes, in order, of (id, language, text) rows whose language has a grammar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):  # small batches out: a file can have very many tokens
                part = b.iloc[lo : lo + 64]
                yield pd.DataFrame({"id": part["id"], "language": part["language"], "t": [lex(t, x) for t, x in zip(part["text"], part["language"], strict=True)]})

    known = texts.where(F.col("language").isin(list(GRAMMARS)) & (F.length("text") > 0))
    shared_dir(texts.sparkSession)
    # three plans read the tokens; without the cut each would lex every file again
    lexed = known.select("id", "language", "text").mapInPandas(run, "id long, language string, t array<string>").checkpoint()
    return lexed.where(F.size("t") > 0)


def syntax_errors(texts: DataFrame) -> DataFrame:
    """Rows (id, why) of those (id, language, text) rows that do not parse.

    Null and empty texts parse, as do texts of comments only; rows of a language without a grammar are not judged. An id
    with several texts is judged by all their tokens together. ``why`` is one of pair, nesting and statement.
    """
    spark = texts.sparkSession
    lexed = tokens(texts)
    plain = lambda c: F.ltrim(c, F.lit("^"))
    # pairs: distinct within the file before they become rows, so that none of the tokens is shuffled
    nxt = lambda i: F.when(F.element_at("t", i + 1) == "EOF", "EOF").when(i == 1, plain(F.element_at("t", i + 1))).otherwise(F.element_at("t", i + 1))
    adjacent = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", plain(F.element_at("t", i)), nxt(i)))
    pairs = lexed.select("id", "language", F.explode(F.array_distinct(adjacent)).alias("pair"))
    allowed = spark.createDataFrame([(x, f"{a} {b}") for x, a, b in permitted()], "language string, pair string")  # bounded by the grammars
    odd = pairs.join(F.broadcast(allowed), ["language", "pair"], "left_anti").select("id", F.lit("pair").alias("why"))

    # nesting: a row a bracket, its depth a running sum, partners next to each other within their depth
    marks = lexed.select("id", F.posexplode("t").alias("pos", "cls")).select("id", "pos", plain(F.col("cls")).alias("b")).where(F.col("b").isin("LP", "LB", "LC", "RP", "RB", "RC"))
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("b").isin("LP", "LB", "LC")
    deep = marks.select("id", "pos", "b", opens.alias("o"), F.sum(F.when(opens, 1).otherwise(-1)).over(upto).alias("depth"))
    brackets = deep.withColumn("at", F.col("depth") + F.when(F.col("o"), 0).otherwise(1))
    same = Window.partitionBy("id", "at").orderBy("pos")
    partner = F.when(F.lag("b").over(same) == "LP", "RP").when(F.lag("b").over(same) == "LB", "RB").when(F.lag("b").over(same) == "LC", "RC")
    nested = brackets.select("id", "at", "o", "b", partner.alias("due"), F.lead("o").over(same).alias("then"))
    wrong = F.when(F.col("o"), F.coalesce(F.col("then"), F.lit(True))).otherwise(~F.col("due").eqNullSafe(F.col("b")))
    loose = nested.where(wrong | (F.col("at") < 1)).select("id", F.lit("nesting").alias("why"))

    # statements: a row a piece up to a semicolon, a brace or a line's end; depth and indentation are running sums
    whole = F.regexp_replace(F.array_join("t", " "), r"\^|^BOF ", "")
    cut = lexed.select("id", "language", F.posexplode(F.split(whole, r"(?<=(?:^|\s)(?:SEMI|LC|RC|NL|NLC)) ")).alias("piece", "raw"))
    count = lambda p: F.regexp_count("raw", F.lit(p))
    steps = cut.select("id", "language", "piece", F.trim(F.regexp_replace("raw", r"(^|\s)(?:INDENT|DEDENT)(?=\s|$)", " ")).alias("shape"), (count(r"\b(?:LP|LB|LC)\b") - count(r"\b(?:RP|RB|RC)\b")).alias("net"), (count(r"\bINDENT\b") - count(r"\bDEDENT\b")).alias("shift"))
    run = Window.partitionBy("id").orderBy("piece")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    pieces = steps.select("id", "language", "piece", "shape", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("outer"), F.sum("shift").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    where = {"any": F.lit(True), "top": F.col("outer") == 0, "end": F.col("shape").endswith("EOF")}
    bad = F.lit(False)
    for languages, place, pattern in NO_PRODUCTION:
        shape = F.regexp_replace("shape", " ?EOF$", "")
        told = F.col("language").isin(languages.split()) & where[place] & (F.length(shape) > 0) & shape.rlike(pattern)
        bad = bad | told
    block = Window.partitionBy("id", "level").orderBy("piece")
    python = F.col("language") == "python"
    follows, leads = F.lead("shape").over(block), F.lag("shape").over(block)
    handled = F.coalesce(follows.rlike(r"^(EXCEPT|FIN) "), F.lit(False))
    opened = F.coalesce(leads.rlike(r"^(TRY|EXCEPT|ELSE) "), F.lit(False))
    judged = pieces.withColumn("bad", bad | (python & F.col("shape").rlike(r"^TRY COLON") & ~handled) | (python & F.col("shape").rlike(r"^(EXCEPT|FIN) ") & ~opened & ~F.coalesce(leads.rlike(r"^TRY"), F.lit(False))))
    # an import list of names must go on with where they come from
    listed = F.col("language").isin("javascript", "typescript") & F.col("shape").rlike(r"^IMP( MOD| ID COMMA)* LC$") & ~F.coalesce(F.lead("shape", 2).over(block).rlike(r"^MOD STR"), F.lit(False))
    judged = judged.withColumn("bad", F.col("bad") | listed)
    shapeless = judged.where("bad").select("id", F.lit("statement").alias("why"))
    return odd.unionByName(loose).unionByName(shapeless).groupBy("id").agg(F.min("why").alias("why"))



def python_confirmed(flagged: DataFrame, texts: DataFrame) -> DataFrame:
    """The flagged rows without those Python files that Python itself can parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        import warnings

        warnings.simplefilter("ignore")
        for b in batches:
            keep = []
            for language, text in zip(b["language"], b["text"], strict=True):
                broken = True
                if language == "python":
                    try:
                        ast.parse(text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n"))
                        broken = False
                    except (SyntaxError, ValueError):
                        pass
                    except (RecursionError, MemoryError):
                        broken = False
                keep.append(broken)
            yield b.loc[keep, ["id", "why"]]

    return flagged.join(texts.select("id", "language", "text"), "id").mapInPandas(run, "id long, why string").distinct()


def broken_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (id, why) of files, by (id, path, language), whose text in sources, by (path, text), does not parse."""
    texts = files.select(F.col("id").cast("long").alias("id"), "path", "language").join(sources.select("path", "text"), "path").where(F.length("text") > 0).select("id", "language", "text")
    return python_confirmed(syntax_errors(texts), texts)


#: fixed values: other spellings of the languages
SPELLINGS = {"py": "python", "python3": "python", "js": "javascript", "mjs": "javascript", "node": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "golang": "go", "rs": "rust", "h": "c"}


def language_name(c: Column) -> Column:
    """A language in its usual spelling, lower case; null stays null."""
    plain = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), plain)

