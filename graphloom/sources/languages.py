"""Symbols and edges of source files in braces or with ``end``: one extractor, driven by a table of declarations a language.

Strings and comments are blanked first, so that declarations, braces and calls are looked for in code only; a declaration
reaches to the brace that closes it. The result has the columns of the Python extractor, file by file, so that a file is
one row of the input and no state is shared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.ingest import SYMBOLS, frame, python_rows

_C = r"//[^\n]*|/\*[\s\S]*?\*/"
_QUOTES = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|readonly|synchronized|native|default|open|fileprivate|mutating|required|convenience|inline|constexpr|extern|unsafe|const|pub(?:\([^)]*\))?|export|declare|partial|get|set)\s+)*"
_GENERIC = r"(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>)?"
#: words before a round bracket that are no calls, and those of single languages
NO_CALLS = frozenset(
    """if for while switch catch return sizeof typeof function func fn when until unless elsif else do try new delete throw throws super this self await yield in of is as not and or
    assert case import export from using lock foreach elseif synchronized instanceof void class struct enum trait impl mod let var const""".split()
)
WORDS_OF = {"go": frozenset("go select defer".split()), "rust": frozenset(("match",)), "swift": frozenset("guard where init".split()), "php": frozenset("list array print echo isset empty match include require".split()), "ruby": frozenset("require include puts raise".split())}


@dataclass(frozen=True)
class Language:
    """How a language is read: what is blanked, and (kind, pattern) of its declarations with the groups name, owner, bases, impls."""

    blank: str
    declarations: tuple[tuple[str, str], ...]
    method_in: tuple[str, ...] = ("class", "interface", "struct")
    imports: tuple[str, ...] = ()
    throws: str = r"\bthrow\s+(?:new\s+)?([A-Za-z_]\w*)"
    ends: bool = False  # blocks end with a word, by indentation
    line_comment: str = "//"
    capital_calls: bool = True
    hidden: str = r"\b(?:private|protected|fileprivate)\b"
    mask: re.Pattern = field(init=False, repr=False)
    rules: tuple[tuple[str, re.Pattern], ...] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "mask", re.compile(self.blank))
        object.__setattr__(self, "rules", tuple((k, re.compile(p, re.M)) for k, p in self.declarations))


_SCRIPT = Language(
    rf"{_C}|`(?:[^`\\]|\\.)*`|{_QUOTES}|(?<=[(,=:\[!&|?{{}};])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
    (
        ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>\w+)\s*{_GENERIC}(?:\s+extends\s+(?P<bases>[\w.]+)\s*{_GENERIC})?(?:\s+implements\s+(?P<impls>[\w.,<>\s]+?))?\s*\{{"),
        ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)\s*{_GENERIC}(?:\s+extends\s+(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
        ("type", rf"^[ \t]*{_MODS}(?:type\s+(?P<name>\w+)\s*{_GENERIC}\s*=|enum\s+(?P<name2>\w+)\s*\{{)"),
        ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*(?P<name>\w+)\s*{_GENERIC}\s*\("),
        ("function", rf"^[ \t]*{_MODS}(?:let|var)?\s*(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=\n]+)?=>"),
        ("member", rf"^[ \t]+{_MODS}\*?(?P<name>[A-Za-z_$][\w$]*)\s*{_GENERIC}\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=\n]+)?\{{"),
    ),
    imports=(r"import\s+(?:type\s+)?(?P<names>[^;'\"]+?)\s+from\s*['\"](?P<module>[^'\"]+)['\"]",),
)
_JVM_MEMBER = rf"^[ \t]+(?:@\w+(?:\([^()]*\))?\s+)*{_MODS}{_GENERIC}\s*(?:[\w.\[\]?]+\s*{_GENERIC}[\[\]?]*\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?:where\s+[^{{;]+)?(?:\{{|=>)"
LANGUAGES = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": Language(
        rf"{_C}|\"\"\"[\s\S]*?\"\"\"|{_QUOTES}",
        (
            ("class", rf"^[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*{_MODS}(?:class|enum|record)\s+(?P<name>\w+)\s*{_GENERIC}(?:\([^()]*\))?(?:\s+extends\s+(?P<bases>[\w.]+)\s*{_GENERIC})?(?:\s+implements\s+(?P<impls>[\w.,<>\s]+?))?\s*\{{"),
            ("interface", rf"^[ \t]*{_MODS}@?interface\s+(?P<name>\w+)\s*{_GENERIC}(?:\s+extends\s+(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("member", _JVM_MEMBER),
        ),
        imports=(r"import\s+(?:static\s+)?(?P<module>[\w.]+\.)(?P<names>\w+|\*)\s*;",),
    ),
    "csharp": Language(
        rf"{_C}|@\"(?:[^\"]|\"\")*\"|\$?{_QUOTES}",
        (
            ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+(?P<name>\w+)\s*{_GENERIC}(?:\([^()]*\))?(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("struct", rf"^[ \t]*{_MODS}(?:struct|enum)\s+(?P<name>\w+)\s*{_GENERIC}(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)\s*{_GENERIC}(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("member", _JVM_MEMBER),
        ),
        imports=(r"using\s+(?P<module>(?:\w+\.)*)(?P<names>\w+)\s*;",),
    ),
    "go": Language(
        rf"{_C}|`[^`]*`|{_QUOTES}",
        (
            ("struct", r"^[ \t]*(?:type\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+struct\s*\{"),
            ("interface", r"^[ \t]*(?:type\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+interface\s*\{"),
            ("function", r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\("),
        ),
        imports=(r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<module>(?:[^\"\n/]+/)*)(?P<names>[^\"\n/]+)\"[ \t]*$",),
        throws=r"\bpanic\(\s*([A-Z]\w*)",
        hidden=r"(?!)",
    ),
    "rust": Language(
        rf"{_C}|r(?P<h>#*)\"[\s\S]*?\"(?P=h)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'",
        (
            ("struct", rf"^[ \t]*{_MODS}(?:struct|enum|union)\s+(?P<name>\w+)"),
            ("interface", rf"^[ \t]*{_MODS}trait\s+(?P<name>\w+)\s*{_GENERIC}(?:\s*:\s*(?P<bases>[\w:+\s<>]+?))?\s*(?:where[^{{]*)?\{{"),
            ("impl", rf"^[ \t]*{_MODS}impl\s*{_GENERIC}\s*(?:(?P<impls>[\w:]+)\s*{_GENERIC}\s+for\s+)?(?P<name>[\w:]+)\s*{_GENERIC}\s*(?:where[^{{]*)?\{{"),
            ("function", rf"^[ \t]*{_MODS}(?:\"[^\"]*\"\s*)?fn\s+(?P<name>\w+)\s*{_GENERIC}\s*\("),
        ),
        imports=(r"use\s+(?P<module>(?:\w+::)*)(?P<names>\w+|\*|\{{[^}}]*\}})\s*;".replace("{{", "{").replace("}}", "}"),),
        throws=r"\bErr\(\s*([A-Z]\w*)",
    ),
    "c": Language(
        rf"{_C}|{_QUOTES}",
        (
            ("struct", r"^[ \t]*(?:typedef\s+)?(?:struct|union|enum)\s+(?P<name>\w+)\s*\{"),
            ("function", r"^(?!\s|else|return|typedef|#)(?:[A-Za-z_][\w\s\*]*?[\s\*])(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*\{"),
        ),
        imports=(r"^[ \t]*#\s*include\s*[<\"](?P<module>(?:[^>\"\n/]+/)*)(?P<names>[^>\"\n/.]+)(?:\.\w+)?[>\"]",),
        throws=r"(?!)()",
        capital_calls=False,
    ),
    "cpp": Language(
        rf"{_C}|R\"\([\s\S]*?\)\"|{_QUOTES}",
        (
            ("class", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[\w:,<>\s]+?))?\s*\{{"),
            ("struct", rf"^[ \t]*(?:typedef\s+)?(?:struct|union|enum(?:\s+class)?)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w:,<>\s]+?))?\s*\{{"),
            ("function", r"^(?!\s|else|return|typedef|#)(?:[A-Za-z_][\w\s\*&:<>,]*?[\s\*&])?(?:(?P<owner>\w+)::)?(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|\s)*(?::[^{;]*)?\{"),
            ("member", rf"^[ \t]+{_MODS}(?:[\w:<>,\*&]+[\s\*&]+)*(?P<name>~?[A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{{;]*)?\{{"),
        ),
        imports=(r"^[ \t]*#\s*include\s*[<\"](?P<module>(?:[^>\"\n/]+/)*)(?P<names>[^>\"\n/.]+)(?:\.\w+)?[>\"]",),
    ),
    "php": Language(
        rf"{_C}|#[^\n\[][^\n]*|{_QUOTES}",
        (
            ("class", rf"^[ \t]*{_MODS}(?:class|trait)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\]+))?(?:\s+implements\s+(?P<impls>[\w\\,\s]+?))?\s*\{{"),
            ("interface", r"^[ \t]*interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\,\s]+?))?\s*\{"),
            ("function", rf"^[ \t]*{_MODS}function\s+&?(?P<name>\w+)\s*\("),
        ),
        imports=(r"^[ \t]*use\s+(?P<module>(?:\w+\\)*)(?P<names>\w+)\s*(?:as\s+\w+\s*)?;",),
    ),
    "swift": Language(
        rf"{_C}|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"",
        (
            ("class", rf"^[ \t]*{_MODS}(?:class|actor)\s+(?P<name>\w+)\s*{_GENERIC}(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("struct", rf"^[ \t]*{_MODS}(?:struct|enum)\s+(?P<name>\w+)\s*{_GENERIC}(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("interface", rf"^[ \t]*{_MODS}protocol\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w.,<>\s]+?))?\s*\{{"),
            ("impl", rf"^[ \t]*{_MODS}extension\s+(?P<name>\w+)(?:\s*:\s*(?P<impls>[\w.,<>\s]+?))?\s*\{{"),
            ("function", rf"^[ \t]*{_MODS}(?:class\s+)?(?:func\s+(?P<name>\w+)|(?P<name2>init))\s*[?!]?\s*{_GENERIC}\s*\("),
        ),
        imports=(r"^[ \t]*import\s+(?:class\s+|struct\s+)?(?P<module>(?:\w+\.)*)(?P<names>\w+)",),
    ),
    "ruby": Language(
        rf"#[^\n]*|^=begin[\s\S]*?^=end|{_QUOTES}",
        (
            ("class", r"^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*(?:::\w+)*)(?:\s*<\s*(?P<bases>[\w:]+))?"),
            ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"),
        ),
        imports=(r"^[ \t]*require(?:_relative)?\s+['\"](?P<module>(?:[^'\"\n/]+/)*)(?P<names>[^'\"\n/]+)['\"]",),
        throws=r"\braise\s+([A-Z]\w*)",
        ends=True,
        line_comment="#",
    ),
}
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<chain>(?:[A-Za-z_$][\w$]*\s*(?:\?\.|\.|::|->)\s*)*)(?P<name>[A-Za-z_$][\w$]*[!?]?)\s*(?:<[\w.,\s]*>)?\(")


def blanked(text: str, language: Language) -> str:
    """The text with strings and comments as blanks, of equal length and lines."""
    return language.mask.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(code: str, at: int) -> int:
    """The place after the brace that closes the first one at or after ``at``; a semicolon before it ends the declaration."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(code)


def _close_by_indent(code: str, at: int) -> int:
    indent = re.match(r"[ \t]*", code[code.rfind("\n", 0, at) + 1 :])[0]
    m = re.compile(rf"^{indent}end\b", re.M).search(code, at)
    return m.end() if m else len(code)


def _last(name: str) -> str:
    return re.split(r"::|\.|\\|/", re.sub(r"<.*", "", name.strip(), flags=re.S).strip())[-1]


def rows_of(path: str, text: str, name: str) -> list[dict]:
    """The symbol and edge rows of one file in the language ``name``."""
    lang = LANGUAGES[name]
    code = blanked(text, lang)
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    from bisect import bisect_right

    line_at = lambda at: bisect_right(starts, at)
    lines = text.split("\n")
    found: list[tuple[int, int, str, re.Match]] = []
    for kind, rule in lang.rules:
        if kind == "member":  # tried only at lines that can begin one
            hits = (m for k, x in enumerate(code.split("\n")) if "(" in x and not x.rstrip().endswith((";", ",")) and x[:1] in " \t" for m in [rule.match(code, starts[k])] if m)
        else:
            hits = rule.finditer(code)
        for m in hits:
            groups = m.groupdict()
            symbol = groups.get("name") or groups.get("name2")
            if not symbol or symbol in NO_CALLS:
                continue
            at = m.start("name") if groups.get("name") else m.start("name2")
            at = code.rfind("\n", 0, at) + 1
            at += len(code[at:]) - len(code[at:].lstrip()) if code[at : at + 1] in " \t" else 0
            # from the end of the head: a brace that the head took is looked for again
            head = m.end() - 1 if m[0].endswith("{") else m.end()
            end = _close_by_indent(code, m.end()) if lang.ends else _close(code, head) if kind != "type" else code.find("\n", m.end()) % (len(code) + 1)
            found.append((at, end, kind, m))
    found.sort(key=lambda x: (x[0], -x[1], x[2] == "member"))
    holders: list[tuple[int, int, str]] = []
    spans: list[tuple[int, int, str]] = []
    rows: list[dict] = []
    seen: set[int] = set()

    def edge(kind: str, source: str, target: str, at: int, receiver: str | None = None) -> None:
        if source and target and source != target:
            rows.append({"row_kind": "edge", "kind": kind, "source_name": source, "target_name": target, "receiver": receiver, "line": line_at(at)})

    for at, end, kind, m in found:
        groups = m.groupdict()
        symbol = groups.get("name") or groups.get("name2")
        around = [h for h in holders if h[0] < at < h[1]]
        owner = groups.get("owner") or (_last(around[-1][2]) if around else None)
        if kind == "member" and (not around or any(s < at < e for s, e, _ in spans if s > around[-1][0])):
            continue
        if at in seen:
            continue
        seen.add(at)
        if kind in ("class", "interface", "struct", "impl"):
            holders.append((at, end, symbol))
            if kind == "impl":
                for base in (groups.get("impls") or "").split(","):
                    edge("implements", _last(symbol), _last(base), at)
                continue
        full = f"{owner}.{symbol}" if owner and kind in ("member", "function") else symbol
        shown = "method" if owner and kind in ("member", "function") else "function" if kind == "member" else kind
        first, last = line_at(at), line_at(max(at, end - 1))
        above = []
        k = first - 2
        while k >= 0 and re.match(r"\s*(?:@\w|#!?\[|\[\w)", lines[k]):
            k -= 1
        if k >= 0 and lines[k].strip().endswith("*/"):
            while k >= 0:
                above.insert(0, lines[k])
                if "/*" in lines[k]:
                    break
                k -= 1
        else:
            while k >= 0 and lines[k].strip().startswith(lang.line_comment):
                above.insert(0, lines[k])
                k -= 1
        head = text[at : m.end()].rstrip("{ \n\t")
        if "(" in head and head.count("(") > head.count(")"):
            close = code.find(")", m.end())
            head = text[at : close + 1] if close > 0 else head
        private = bool(re.search(lang.hidden, m[0])) or symbol.startswith("_") or (name == "go" and symbol[:1].islower()) or (name == "rust" and "pub" not in m[0])
        rows.append({
            "row_kind": "symbol", "name": full, "kind": shown, "start_line": first, "end_line": last, "docstring": "\n".join(x.strip() for x in above) or None,
            "signature": " ".join(head.split()), "decorators": [], "visibility": "private" if private else "public", "line": first,
        })
        if shown in ("function", "method"):
            spans.append((at, end, full))
        for kind_, listed in (("extends", groups.get("bases")), ("implements", groups.get("impls"))):
            for base in (listed or "").split(","):
                edge(kind_, symbol, _last(base), at)

    def inside(at: int) -> str | None:
        best = None
        for s, e, full in spans:
            if s > at:
                break
            if s < at < e:
                best = full
        return best

    spans.sort()
    declared = {m.start("name") if m.groupdict().get("name") else m.start() for _, _, _, m in found}
    for m in _CALL.finditer(code):
        called = m["name"].rstrip("!?")
        if called in NO_CALLS or called in WORDS_OF.get(name, ()) or m.start("name") in declared:
            continue
        source = inside(m.start())
        if not source:
            continue
        chain = re.sub(r"\s+", "", m["chain"]).rstrip(".:->?")
        made = bool(m["new"]) or (lang.capital_calls and not chain and called[:1].isupper() and name not in ("go", "csharp"))
        edge("instantiates" if made else "call", source, called, m.start(), chain[:80] or None)
    for m in re.finditer(lang.throws, code):
        source = inside(m.start())
        if source and m[1] and m[1][:1].isupper():
            edge("raises", source, m[1], m.start())
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    for pattern in lang.imports:
        for m in re.finditer(pattern, text, re.M):
            if name == "go" and not re.search(r"import\s*(?:\([^)]*|\"[^\"]*|\w+\s+\"[^\"]*)$", text[: m.end() - 1]):
                continue
            for one in re.sub(r"[{}*]", " ", m["names"]).split(","):
                target = re.sub(r"^\s*type\s+|\s+as\s+.*$", "", one.strip()).strip()
                if target:
                    edge("import", stem, target, m.start())
    for r in rows:
        r["path"] = path
    return rows


def extract(texts: DataFrame) -> DataFrame:
    """Symbol and edge rows, told apart by ``row_kind``, of (path, language, text) files in any language that is known here.

    Null and empty texts and other languages give no rows; Python files that do not parse give none, others what can be
    read of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for p, g, t in zip(b["path"], b["language"], b["text"], strict=True):
                t = t.replace("\r\n", "\n")
                rows += python_rows(p, t) if g == "python" else rows_of(p, t, g)
            yield frame(rows)

    known = texts.where(F.col("language").isin("python", *LANGUAGES) & (F.length("text") > 0))
    return known.select("path", "language", "text").mapInPandas(run, SYMBOLS)
