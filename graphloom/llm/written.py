"""Source files that nobody wrote by hand in their repository: generated, compacted, third-party, or data held as code.

Notices are matched in the comment block that a file begins with, by one Aho-Corasick automaton over all phrases; paths
are matched by folder names, lock files and suffixes; compacted code and data tables are told by the shape of the whole
text. Third-party code is also found where it is kept without a notice: a file whose code, comments at its top left
aside, equals that of a recognised third-party file is third-party too (a join on a hash of the code).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.registry import shared_dir

#: phrases of notices, lower case, and what they say of the file
NOTICES = {
    "generated": (
        "code generated", "@generated", "<auto-generated", "<autogenerated", "autogenerated", "auto-generated file", "auto-generated by", "auto generated by", "automatically generated", "machine generated",
        "machine-generated", "machine-made", "computer generated", "generated file", "file is generated", "file was generated", "file has been generated", "generated from", "generated automatically", "generated code",
        "do not edit", "don't edit", "do not modify", "do not change by hand", "not be edited", "edit the template", "edits get overwritten", "edits will be overwritten", "changes will be lost", "changes are lost",
        "will be overwritten", "derived file", "regenerate with", "regenerated by", "produced by `", "produced by make", "output of tools/", "emitted by",
        "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "nicht bearbeiten", "nicht von hand", "nicht editieren", "generierte datei",
        "fichier produit par", "fichier généré", "généré automatiquement", "ne pas modifier", "ne pas éditer", "generado automáticamente", "archivo generado", "no editar", "no modificar", "código generado",
    ),
    "third_party": (
        "copied from", "upstream release", "vendored from", "vendored copy", " contributors", "originally from", "taken from the", "third-party", "third party", "imported from upstream", "bundled from", "backported from",
        "project, version", "| mit license |", "| apache", "| bsd",
    ),
    "hand": ("not generated", "safe to edit", "edit freely", "hand-maintained", "hand maintained", "written by hand", "hand-written", "method stub", "rest of this repository", "authors of this repository"),
}
SOURCE_LINE = re.compile(r"^\W*source:\s*\S+\.(?:proto|idl|yaml|yml|json|thrift|avsc|fbs|g4|xsd|wsdl|graphql)\W*$", re.I | re.M)
THIRD_DIRS = frozenset("vendor third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages site-packages dist-packages external extern externals deps godeps pods carthage".split())
MADE_DIRS = frozenset("generated __generated__ autogen autogenerated gen dist generated-sources generated_src".split())
LOCKS = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock pipfile.lock uv.lock composer.lock gemfile.lock go.sum flake.lock bun.lock".split())
MADE_NAME = re.compile(r"(?:[._-](?:generated|autogen|designer|g)\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|c|rs)|_grpc\.pb\.go|Generated\.(?:java|kt|cs|swift)|_generated\.\w+|\.pb\.ts|_pb\.d\.ts)$")
COMPACT_NAME = re.compile(r"(?:[.-]min\.(?:m|c)?js|\.min\.css|\.bundle\.(?:m|c)?js|\.js\.map|\.prod\.(?:m|c)?js)$", re.I)
HASHED_NAME = re.compile(r"^(?:chunk|bundle|runtime|main|vendor|vendors|app|index|polyfills)[.-](?=[0-9a-z]*\d)[0-9a-z]{7,}\.(?:m|c)?js$", re.I)
ASSETS = re.compile(r"/(?:static/js|public/assets|build/static|build/js|assets/js|wwwroot/js|dist)/", re.I)
COMMENT = re.compile(r"\s*(?:#!.*|(?:#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif|else|undef)\b)|//|;;|--).*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[a-zA-Z]{0,3}\b")
WORD = re.compile(r"[^\W\d]\w*")
FREE = re.compile(r"/\*[\s\S]*?\*/|^\s*(?://|#(?!\s*include)).*$", re.M)

_built: list[object] = []


def automaton():
    """The automaton over all notices; built once a worker."""
    if not _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, phrases in NOTICES.items():
            for p in phrases:
                a.add_word(p, kind)
        a.make_automaton()
        _built.append(a)
    return _built[0]


def head_of(text: str) -> tuple[str, str]:
    """The comments that a text begins with, and the rest."""
    at = 0
    while m := COMMENT.match(text, at):
        at = m.end()
    return text[:at], text[at:]


def by_path(path: str) -> str | None:
    """What a path alone tells: third_party, generated, compacted, or nothing."""
    parts = path.replace("\\", "/").split("/")
    folders, name = {x.lower() for x in parts[:-1]}, parts[-1]
    if folders & THIRD_DIRS:
        return "third_party"
    if COMPACT_NAME.search(name) or (HASHED_NAME.match(name) and ASSETS.search(path)):
        return "compacted"
    if folders & MADE_DIRS or MADE_NAME.search(name) or name.lower() in LOCKS:
        return "generated"
    return None


def is_compacted(text: str) -> bool:
    """Long, dense lines all through: code that a program has squeezed.

    A short text must be nearly one line, with hardly a blank and much punctuation, to tell it from terse hand-writing.
    """
    body = [x for x in FREE.sub("", text).splitlines() if x.strip()]
    size = sum(map(len, body))
    joined = "".join(body)
    blanks = sum(joined.count(c) for c in " \t")
    if size < 400:
        signs = sum(joined.count(c) for c in "(){}[];,=!&|")
        return size >= 120 and max(map(len, body)) >= 0.8 * size and blanks <= 0.06 * size and signs >= 0.15 * size
    long = sum(len(x) for x in body if len(x) > 200)
    return long >= 0.8 * size and blanks <= 0.09 * size


def is_data(text: str) -> bool:
    """Hardly anything but literals: very many of them, or few that are very long."""
    body = FREE.sub("", text)
    strings = STRING.findall(body)
    bare = STRING.sub(" ", body)
    numbers, words = len(NUMBER.findall(bare)), len(WORD.findall(NUMBER.sub(" ", bare)))
    literals, held = len(strings) + numbers, sum(map(len, strings))
    return (literals >= 80 and words <= 0.12 * literals) or (held >= 4000 and held >= 0.9 * len(body) and words <= 30)


def judge(path: str | None, text: str | None) -> tuple[str | None, str | None]:
    """(reason or None, the code without its head comments or None if there is none)."""
    told = by_path(path) if path else None
    if not text:
        return told, None
    head, body = head_of(text.lstrip("﻿"))
    kinds: set[str] = set()
    if head:
        low = head.lower()
        for m in automaton().iter(low):
            kinds.add(m[1])
        for line in low.splitlines():  # a line that disclaims says nothing else
            if any(p in line for p in NOTICES["hand"]):
                here = {k for _, k in automaton().iter(line)} - {"hand"}
                elsewhere = {k for x in low.splitlines() if x != line for _, k in automaton().iter(x)}
                kinds -= here - elsewhere
    body = body.strip()
    if told == "third_party" or "third_party" in kinds:
        return "third_party", body
    if told:
        return told, body
    if "generated" in kinds or SOURCE_LINE.search(head):
        return "generated", body
    if is_compacted(text):
        return "compacted", body
    return ("data" if is_data(text) else None), body


def not_handwritten(files: DataFrame, sources: DataFrame, id_col: str = "id", path_col: str = "path", text_path: str = "path", text_col: str = "text", least_copy: int = 60) -> DataFrame:
    """Rows (id, reason) of the files that are not hand-written: generated, compacted, third_party or data.

    A file without text, or with a null or empty one, is judged by its path; a null path and pseudo files, whose path
    starts with a colon, tell nothing. Copies count as such from ``least_copy`` characters of code on. Several texts of
    one path are all looked at, and one reason comes out, the first in alphabetical order.
    """
    f = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").alias("path"))
    s = sources.select(F.col(f"`{text_path}`").alias("path"), F.col(f"`{text_col}`").alias("text"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            found = [judge(p, t) if not (p or "").startswith(":") else (None, None) for p, t in zip(b["path"], b["text"], strict=True)]
            codes = [xxhash.xxh3_64_intdigest(c.replace("\r\n", "\n")) - (1 << 63) if c and len(c) >= least_copy else None for _, c in found]
            yield pd.DataFrame({"id": b["id"], "reason": [r for r, _ in found], "code": pd.array(codes, dtype="Int64")})

    shared_dir(files.sparkSession)
    # both branches below read what was looked at: without the cut every text would be judged twice
    looked = f.join(s, "path", "left").mapInPandas(look, "id long, reason string, code long").checkpoint()
    foreign = looked.where((F.col("reason") == "third_party") & F.col("code").isNotNull()).select("code").distinct()
    few = foreign.count() <= 500_000  # 4 MB
    copies = looked.where(F.col("reason").isNull() & F.col("code").isNotNull()).join(F.broadcast(foreign) if few else foreign, "code", "left_semi")
    told = looked.where(F.col("reason").isNotNull()).select("id", "reason").unionByName(copies.select("id", F.lit("third_party").alias("reason")))
    return told.groupBy("id").agg(F.min("reason").alias("reason"))
