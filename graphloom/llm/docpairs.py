"""Functions and methods paired with their documentation.

A symbol's documentation is its stored docstring or, where that is null, what the file's text holds at the declaration:
a Python docstring, or the comment block that stands directly above (annotations and attributes may lie between). It is
split into prose and tags; it is trivial if the prose, without placeholders, directives, licence text, pointers
elsewhere, switched-off code and what the name, parameters and types say already, has hardly a word left. Methods
without own documentation take that of the method they override, found by joining the class hierarchy step by step.
Symbols are gathered per file, so that each text is read once and never copied for each of its symbols.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.registry import shared_dir
from graphloom.llm.written import NOTICES
from graphloom.operators.repos import owned

TAG = re.compile(
    r"^\s*(?:[@\\](?P<at>[A-Za-z][\w-]*)(?P<rest>.*)|:(?P<field>param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|meta|yields?|ytype|private|public)\b(?P<more>[^:]*):?(?P<tail>.*))$"
)
SECTION = re.compile(r"^\s*(?:args?|arguments?|parameters?|params?|returns?|raises?|yields?|throws|attributes?|see also|references?|paramètres|parámetros|parameter|rückgabe|retour|devuelve)\s*:?\s*$", re.I)
UNDERLINE = re.compile(r"^\s*[-=~*#_+^.]{2,}\s*$")
#: prose that stands in for documentation or points elsewhere, matched against one whole sentence or line in lower case
NOTHING = re.compile(
    r"""^\W*(?:
    (?:todo|fixme|xxx|wip|tbd|tba|hack|nocommit)\b.* | n/?a | none | null | void | - | \?+ | \.+
    | (?:no\ )?(?:doc|docs|docstring|documentation|description|summary|comment)s?(?:\ (?:goes\ here|missing|pending|needed|to\ follow|here|follows|tbd|todo|string))?
    | (?:needs?|missing|lacks|requires?|add|write|insert|enter|fill\ in|put|your|provide|replace\ with|describe|document)\ (?:a\ |the\ |some\ |your\ |this\ |me\ |in\ )*(?:doc\w*|summary|description|comment|text|function|method|here|me|this|it)?(?:\ (?:goes\ )?here|\ of\ \w+|\ below)?
    | blah(?:\ blah)* | asdf\w* | foo|bar|baz|qux | test(?:ing)? | some\ text | lorem\ ipsum.* | place\ ?holder.* | dummy.* | sample\ text | text
    | (?:todo\ )?auto[-\ ]?generated\b.* | generated\ by\b.* | created\ by\b.* | automatically\ generated\b.*
    | (?:helper|callback|constructor|destructor|main|internal|getter|setter|private|public|inherited|override[sn]?|accessor|initiali[sz]er|deprecated|wrapper|handler|entry\ point|default|implementation|utility)(?:\ (?:function|method|helper|only|use\ only|class))?
    | (?:please\ )?(?:see|refer\ to|cf\.?|check|consult|look\ at|voir|siehe|vgl\.?|véase|ver)\b.* | same\ as\b.* | as\ above\b.* | ditto | like\ above\b.* | (?:documented|described|explained)\ (?:elsewhere|in|at|above|below)\b.*
    | inherit(?:s|ed)?(?:\ (?:doc\w*|from\ .*))? | \{?@?inherit_?doc(?:umentation)?\}? | \(non-javadoc\) | copydoc\b.*
    | (?:does|do)\ (?:exactly\ )?what\ (?:the\ name|it|its\ name)\b.* | self[-\ ]?explanatory.* | (?:the\ )?name\ says\ it\ all | obvious | trivial | nothing\ to\ see\ here
    | spdx-.* | .*\b(?:all\ rights\ reserved|licen[sc]ed\ under|permission\ is\ hereby\ granted|without\ warrant(?:y|ies)|redistribution\ and\ use)\b.* | (?:\(c\)|copyright|©)\ .*
    | (?:noqa|type:\s*ignore|pylint|eslint(?:-\w+)*|nolint\w*|istanbul|c8\s+ignore|ts-ignore|ts-expect-error|ts-nocheck|tslint|jshint|jslint|prettier-ignore|flake8|mypy|pyright|fmt:|yapf|isort|coverage|pragma|go:\w+|nosec|nosonar|checkstyle|suppress\w*|clang-format|clang-tidy|sonar|rustfmt|region|endregion|spell-?checker|cspell|meta\ private|@\w+)\b.*
    | _+\w+_+ | _type_.* | \[?(?:summary|description|type)\]? | \$\{?\w+\}? | <[\w\s-]+> | %\w+%
    )\W*$""",
    re.X,
)
TEMPLATE = re.compile(r"_summary_|_description_|_type_|\[summary\]|\[description\]|<summary>\s*</summary>|\bDOCSTRING\b|\{\{.*?\}\}|\$\{\w+\}")
CODE = re.compile(r"(?:[;{}]\s*$)|^\s*(?:if|for|while|return|else|elif|try|catch|var|let|const|def|func|fn|import|from|print|throw|raise|switch|case)\b[^.]*[(=;:{]|^\s*[\w.\[\]'\"]+\s*(?:=|\+=|:=|==)\s*\S|^\s*[\w.]+\([^)]*\)\s*[;:]?\s*$|=>|&&|\|\||^\s*[}\])]+;?\s*$")
LICENCE = re.compile(r"licen[sc]ed|copyright|spdx|warrant|all rights reserved|permission is hereby|redistribut|apache license|mit license|\bgpl\b", re.I)
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:nbsp|lt|gt|amp|quot|#\d+);|\{@(?:code|link|literal|linkplain)\s+([^}]*)\}")
ASKS = re.compile(r"(?:still |yet )?(?:needs?|lacks|wants|missing|without|awaits?|requires) (?:an? |any |its |proper )?(?:description|documentation|docstring|docs?|summary)\b|(?:please|someone) (?:write|add|fill|document|describe)\b|(?:write|add|fill in) (?:me|one|this|a description|documentation)\b|not (?:yet )?documented|undocumented")
#: words that tell nothing by themselves, several languages
EMPTY_WORDS = frozenset(
    """a an the this that these those it its of for to in on at by with from and or is are be was as not no function method helper class object value values
    param parameter parameters argument arguments return returns returned returning result results given used use using type types string int integer number list dict map array bool boolean any void none null float str bytes self
    der die das ein eine und oder von für mit zu funktion methode le la les un une des et ou de du fonction méthode el los las una y o función método gets get sets set does do""".split()
)
WORD = re.compile(r"[^\W\d_]+")


def unmark(doc: str) -> str:
    """Documentation without comment syntax, quotes and markup."""
    t = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    t = re.sub(r"^[rRuUbBfF]{0,2}(\"\"\"|''')([\s\S]*?)(?:\1)?$", r"\2", t)
    lines = []
    for line in t.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|\*/|\*(?!\*\w)|///?!?|//!|#+!?(?=\s|$|[A-Za-z])|--(?=\s)|;;+)?", "", line, count=1)
        lines.append(re.sub(r"\s*\*+/\s*$", "", line))
    t = "\n".join(lines)
    return MARKUP.sub(lambda m: m[1] or " ", t)


def parts_of(*names: str | None) -> set[str]:
    """The words that names are made of, lower case."""
    out: set[str] = set()
    for n in names:
        for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|[^\W\d_]+", n or ""):
            out.add(w.lower())
        for w in WORD.findall(n or ""):
            out.add(w.lower())
    return out


def prose_and_tags(doc: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The prose lines of documentation, and its tags with their text."""
    prose: list[str] = []
    tags: list[tuple[str, str]] = []
    section, indent = "", 0
    for line in unmark(doc).split("\n"):
        if UNDERLINE.match(line):
            continue
        if SECTION.match(line):
            section, indent = line.strip().rstrip(":").lower(), len(line) - len(line.lstrip())
            continue
        if m := TAG.match(line):
            tags.append((m["at"] or m["field"], (m["rest"] or m["tail"] or "").strip()))
            section = "tag"
            continue
        if not line.strip():
            section = "" if section == "tag" else section
            continue
        if section and (section == "tag" or len(line) - len(line.lstrip()) > indent):
            tags.append((section, line.strip()))
            continue
        section = ""
        prose.append(line.strip())
    return prose, tags


def tells(doc: str | None, name: str | None = None, signature: str | None = None, least: int = 3) -> bool:
    """Whether documentation says something that name, parameters and types do not.

    True where the prose, or the text of a tag, keeps at least ``least`` distinct new words in one sentence; null and
    empty documentation says nothing.
    """
    if not doc or not doc.strip():
        return False
    if TEMPLATE.search(doc):
        doc = TEMPLATE.sub(" ", doc)
    known = parts_of(name, signature)
    prose, tags = prose_and_tags(doc)
    if LICENCE.search(doc) and len(LICENCE.findall(" ".join(prose))) * 25 >= len(WORD.findall(" ".join(prose))):
        return False
    kept = [x for x in prose if not CODE.search(x)]
    if prose and not kept:
        return False
    sentences: list[str] = []
    for line in kept:
        if NOTHING.match(line.lower()):
            sentences.append("")
        else:
            sentences.append(line)
    joined = " ".join(sentences)
    candidates = re.split(r"(?<=[.!?;:])\s+", joined)
    for s in candidates:
        low = s.lower().strip()
        if not low or NOTHING.match(low) or ASKS.search(low) or any(x in low for x in NOTICES["generated"]):
            continue
        words = WORD.findall(low)
        fresh = {w for w in words if w not in known and w not in EMPTY_WORDS and not any(w == k + "s" or w + "s" == k for k in known)}
        if len(words) >= 4 and len(fresh) >= least:
            return True
        letters = re.findall(r"[぀-ヿ㐀-鿿가-힯]", low)
        if len(letters) >= 6:
            return True
    for _, text in tags:
        words = WORD.findall(text.lower())
        if CODE.search(text) or NOTHING.match(text.lower()):
            continue
        fresh = {w for w in words if w not in known and w not in EMPTY_WORDS}
        if len(words) >= 7 and len(fresh) >= least + 1:
            return True
    return False


DECLARES = re.compile(r"\s*(?:async\s+)?(?:def|class)\b")
DOC_STARTS = re.compile(r"(?:\s|#.*\n)*[rRuU]?(\"\"\"|'''|\"|')")
DOC_ENDS = {q: re.compile(r"(?:[^\\]|\\[\s\S])*?" + q) for q in ('"""', "'''", '"', "'")}
#: fixed values: what a line comment begins with, by language; others have // only
LINE_COMMENTS = {"ruby": "#", "shell": "#", "bash": "#", "perl": "#", "r": "#", "yaml": "#", "elixir": "#", "php": "#", "sql": "--", "lua": "--", "haskell": "--", "ada": "--"}


class Lines(list):
    """The lines of a text, which also knows the text and where in it each line starts."""

    def __init__(self, text: str) -> None:
        super().__init__(text.split("\n") if text else [])
        self.text = text
        self.starts: list[int] = []
        at = 0
        for line in self:
            self.starts.append(at)
            at += len(line) + 1


def _python_doc(lines: Lines, at: int) -> str | None:
    while at < len(lines) and lines[at].lstrip().startswith("@"):
        at += 1
    text = lines.text
    m = DECLARES.match(text, lines.starts[at]) if at < len(lines) else None
    if not m:
        return None
    depth, i, quote = 0, m.end(), ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return None
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            break
        i += 1
    d = DOC_STARTS.match(text, i + 1)
    end = DOC_ENDS[d[1]].match(text, d.end()) if d else None
    return text[d.end() : end.end() - len(d[1])] if end else None


def _comment_above(lines: Lines, at: int, mark: str = "//") -> str | None:
    i = at - 1
    while i >= 0 and re.match(r"\s*(?:@\w|#!?\[|\[\[|template\s*<)", lines[i]):
        i -= 1
    if i < 0:
        return None
    line = lines[i].strip()
    if line.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j < 0 or lines[j].split("/*")[0].strip():
            return None
        return "\n".join(lines[j : i + 1])
    for m in {"//", mark}:
        if line.startswith(m):
            j = i
            while j >= 0 and lines[j].strip().startswith(m):
                j -= 1
            return "\n".join(lines[j + 1 : i + 1])
    return None


def doc_in_text(lines: Lines | list[str], start_line: int | None, language: str | None) -> str | None:
    """The documentation that a file's lines hold for the declaration at ``start_line``; null if there is none."""
    if not start_line or start_line < 1 or start_line > len(lines):
        return None
    if not isinstance(lines, Lines):
        lines = Lines("\n".join(lines))
    if language == "python":
        return _python_doc(lines, start_line - 1)
    mark = LINE_COMMENTS.get(language or "", "//")
    at = start_line - 1
    while at < len(lines) and re.match(r"\s*(?:@\w+(?:\([^)]*\))?\s*$|#!?\[.*\]\s*$)", lines[at]):  # begins at an annotation
        at += 1
    return _comment_above(lines, start_line - 1, mark) or (_comment_above(lines, at, mark) if at != start_line - 1 else None)


def documented(symbols: DataFrame, files: DataFrame, sources: DataFrame, per_row: int = 20_000) -> DataFrame:
    """Rows (id, file_id, name, start_line, documentation, told, code) of functions and methods.

    ``documentation`` is the symbol's own, cleaned of comment syntax, null where there is none; ``told`` says whether it
    tells something; ``code`` are the lines from start_line to end_line, null without a text or lines. Symbols without a
    file or start line are left out, as they cannot be placed; repeated symbol rows stay. The symbols of a file meet its
    text in one row, or in as many rows as hold about ``per_row`` of them each.
    """
    wanted = symbols.where(F.col("kind").isin("function", "method") & F.col("file_id").isNotNull() & F.col("start_line").isNotNull())
    one = F.struct(*[F.col(c) for c in ("id", "name", "start_line", "end_line", "docstring", "signature")])
    large = wanted.groupBy("file_id").agg(F.ceil(F.count(F.lit(1)) / per_row).cast("int").alias("rows")).where("rows > 1").checkpoint()
    if large.isEmpty():
        per_file = wanted.groupBy("file_id").agg(F.collect_list(one).alias("s"))
    else:
        split = wanted.join(large, "file_id", "left").withColumn("part", F.pmod(F.xxhash64("id", "start_line"), F.coalesce("rows", F.lit(1))))
        per_file = split.groupBy("file_id", "part").agg(F.collect_list(one).alias("s")).drop("part")
    texts = files.select(F.col("id").alias("file_id"), "path", "language").join(sources.select("path", "text"), "path", "left").select("file_id", "language", "text")
    rows = per_file.join(texts, "file_id", "left").select("file_id", "language", "text", "s")
    schema = "id long, file_id long, name string, start_line int, documentation string, told boolean, code string"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, language, text, found in zip(b["file_id"], b["language"], b["text"], b["s"], strict=True):
                lines = Lines(text or "")
                for s in found:
                    doc = s["docstring"]
                    if doc is None:
                        doc = doc_in_text(lines, s["start_line"], language)
                    end = s["end_line"] if s["end_line"] is not None else s["start_line"]
                    code = "\n".join(lines[max(0, s["start_line"] - 1) : int(end)]) if lines else None
                    out.append((s["id"], file_id, s["name"], s["start_line"], unmark(doc).strip() if doc is not None else None, tells(doc, s["name"], s["signature"]), code))
            yield pd.DataFrame(out, columns=["id", "file_id", "name", "start_line", "documentation", "told", "code"])

    return rows.mapInPandas(look, schema)


def resolve_inherited(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, documentation, inherited_from) for those methods of ``docs`` without telling documentation that override
    a documented one.

    A method is named Class.method; ``edges`` of kind extends and implements lead from a class to its bases, by name,
    within a ``scope`` (a repository) that both ``docs`` and ``edges`` may have as a column, so that classes of one name in
    different repositories are not taken for each other. Each step goes one class up and joins the base's method; the
    nearest base wins, the first in alphabetical order among bases as near, the smallest id among homonyms. It ends when
    no method has a base left that it has not met, so cycles end and no depth is lost.
    """
    method = F.regexp_extract("name", r"([^.:]+)$", 1)
    owner = F.regexp_extract("name", r"([^.:]+)(?:\.|::)[^.:]+$", 1)
    scope_of = lambda df: (F.coalesce("scope", F.lit("")) if "scope" in df.columns else F.lit("")).alias("scope")
    named = docs.select("id", scope_of(docs), "told", "documentation", method.alias("method"), owner.alias("owner")).where(F.col("owner") != "")
    best = named.where("told").groupBy("scope", F.col("owner").alias("base"), "method").agg(F.min_by("documentation", "id").alias("documentation"))
    up = edges.where(F.col("kind").isin("extends", "implements") & (F.col("source_name") != F.col("target_name")))
    up = up.select(scope_of(up), F.col("source_name").alias("owner"), F.col("target_name").alias("base")).distinct().checkpoint()
    left = named.where(~F.col("told")).select("id", "scope", "method", "owner").join(up.select("scope", "owner").distinct(), ["scope", "owner"], "left_semi").checkpoint()
    met, out = left.select("id", F.col("owner").alias("base")), None
    while not left.isEmpty():
        reached = left.join(up, ["scope", "owner"]).select("id", "scope", "method", "base").distinct().join(met, ["id", "base"], "left_anti")
        reached = reached.join(best, ["scope", "base", "method"], "left").checkpoint()
        hit = reached.where(F.col("documentation").isNotNull()).groupBy("id").agg(F.min_by(F.struct("documentation", "base"), "base").alias("d"))
        found = hit.select("id", F.col("d.documentation").alias("documentation"), F.col("d.base").alias("inherited_from"))
        out = found if out is None else out.unionByName(found)
        met = met.unionByName(reached.select("id", "base"))
        left = reached.join(hit.select("id"), "id", "left_anti").select("id", "scope", "method", F.col("base").alias("owner")).checkpoint()
    return docs.sparkSession.createDataFrame([], "id long, documentation string, inherited_from string") if out is None else out


def code_pairs(symbols: DataFrame, files: DataFrame, sources: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows (id, file_id, name, start_line, code, documentation, inherited_from) of the functions and methods that have
    documentation which tells something, their own (``inherited_from`` is null) or that of the method they override.

    Functions without a text have a null ``code``; repeated symbol rows all come out; empty tables give no rows.
    """
    shared_dir(symbols.sparkSession)
    home = owned(files, repos).select(F.col("id").alias("file_id"), F.col("repo_alias").alias("scope"))
    docs = documented(symbols, files, sources).checkpoint()
    own = docs.where("told").select("id", "file_id", "name", "start_line", "code", "documentation", F.lit(None).cast("string").alias("inherited_from"))
    narrow = docs.select("id", "file_id", "name", "told", F.when(F.col("told"), F.col("documentation")).alias("documentation"))
    links = edges.where(F.col("kind").isin("extends", "implements"))
    found = resolve_inherited(narrow.join(home, "file_id", "left"), links.join(home, "file_id", "left"))
    more = docs.where(~F.col("told")).drop("documentation").join(found, "id").select(*own.columns)
    return own.unionByName(more)
