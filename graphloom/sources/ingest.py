"""From files to tables: scans, Python extraction, comment markers, Markdown headings, references and unified diffs."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: folders that a scan leaves out, suffixes it keeps and the languages they stand for
SKIP = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", ".git")
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "php": "php", "swift": "swift", "md": "markdown", "markdown": "markdown",
}
MAX_BYTES = 1 << 20


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, file_hash, mtime, text) of the source files below ``root``: known suffixes, no hidden or skipped
    folders, no minified files, at most ``max_bytes`` (a megabyte unless asked otherwise). Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]
    skipped = path.rlike(r"/(" + "|".join(s.replace(".", r"\.") for s in SKIP) + r")/|/\.(?!claude)[^/]+/|\.min\.")
    return files.where((F.col("length") <= max_bytes) & ~skipped & language.isNotNull()).select(path.alias("path"), language.alias("language"), F.sha1("content").alias("file_hash"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


SYMBOLS = "path string, row_kind string, name string, kind string, start_line int, end_line int, docstring string, signature string, decorators array<string>, visibility string, source_name string, target_name string, receiver string, line int"


def python_rows(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[dict] = []

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            return n.attr
        return dotted(n.value) if isinstance(n, ast.Subscript) else dotted(n.func) if isinstance(n, ast.Call) else None

    def edge(kind: str, source: str | None, target: str | None, line: int, receiver: str | None = None) -> None:
        if source and target:
            rows.append({"row_kind": "edge", "kind": kind, "source_name": source, "target_name": target, "receiver": receiver, "line": line})

    def types(n: ast.AST | None) -> list[str]:
        """The names of the classes that an annotation speaks of, builtins aside."""
        out = [dotted(x) for x in ast.walk(n) if isinstance(x, (ast.Name, ast.Attribute))] if n is not None else []
        return [x for x in dict.fromkeys(out) if x and x[:1].isupper()]

    def fields_of(n: ast.ClassDef) -> dict[str, tuple[int, ast.AST | None]]:
        out: dict[str, tuple[int, ast.AST | None]] = {}
        for x in n.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                out.setdefault(x.target.id, (x.lineno, x.annotation))
            if isinstance(x, ast.FunctionDef) and x.name == "__init__":
                given = {a.arg: a.annotation for a in x.args.args}
                for y in ast.walk(x):
                    for t in y.targets if isinstance(y, ast.Assign) else [y.target] if isinstance(y, ast.AnnAssign) else []:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            kind = y.annotation if isinstance(y, ast.AnnAssign) else given.get(y.value.id) if isinstance(y.value, ast.Name) else y.value.func if isinstance(y.value, ast.Call) else None
                            out.setdefault(t.attr, (y.lineno, kind))
        return out

    def visit(node: ast.AST, owner: str, inside: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{n.name}" if owner else n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                sig = None if kind == "class" else f"def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                rows.append({"row_kind": "symbol", "name": name, "kind": kind, "start_line": n.lineno, "end_line": n.end_lineno, "docstring": ast.get_docstring(n), "signature": sig, "decorators": [ast.unparse(d) for d in n.decorator_list], "visibility": "private" if n.name.startswith("_") else "public", "line": n.lineno})
                if kind == "class":
                    for b in n.bases:
                        edge("extends", name, dotted(b), n.lineno)
                    for f, (line, annotation) in fields_of(n).items():
                        rows.append({"row_kind": "symbol", "name": f"{n.name}.{f}", "kind": "field", "start_line": line, "end_line": line, "docstring": None, "signature": None, "decorators": [], "visibility": "private" if f.startswith("_") else "public", "line": line})
                        for t in types(annotation):
                            edge("holds", name, t, line)
                else:
                    for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                        for t in types(a.annotation):
                            edge("uses", name, t, n.lineno)
                # what stands in a function belongs to it; only a class's own functions are its methods
                visit(n, n.name if kind == "class" else "", name)
                continue
            if isinstance(n, ast.Call):
                receiver = ast.unparse(n.func.value) if isinstance(n.func, ast.Attribute) else None
                target = dotted(n.func)
                made = receiver is None and target is not None and target[:1].isupper()
                edge("instantiates" if made else "call", inside, target, n.lineno, receiver if receiver is None or len(receiver) < 80 else None)
            elif isinstance(n, ast.Raise) and n.exc is not None:
                edge("raises", inside, dotted(n.exc), n.lineno)
            elif isinstance(n, ast.ExceptHandler) and n.type is not None:
                for t in n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]:
                    edge("catches", inside, dotted(t), n.lineno)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    edge("import", path.rsplit("/", 1)[-1].rsplit(".", 1)[0], a.name.rsplit(".", 1)[-1], n.lineno)
            elif isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Attribute) and isinstance(n.target.value, ast.Name) and n.target.value.id == "self" and inside:
                edge("reads", inside, n.target.attr, n.lineno, "self")
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and inside:
                edge("writes" if isinstance(n.ctx, (ast.Store, ast.Del)) else "reads", inside, n.attr, n.lineno, "self")
            visit(n, owner, inside)

    visit(tree, "", None)
    for r in rows:
        r["path"] = path
    return rows


def frame(rows: list[dict]) -> pd.DataFrame:
    """Rows as a frame of the columns of ``SYMBOLS``, with nulls where a row has none."""
    columns = [c.split()[0] for c in SYMBOLS.split(", ")]
    out = pd.DataFrame(rows, columns=columns)
    whole = ("start_line", "end_line", "line")
    return out.assign(**{c: out[c].astype("Int32") if c in whole else out[c].astype(object).where(out[c].map(lambda v: isinstance(v, (str, list))), None) for c in columns})


def extract_python(texts: DataFrame) -> DataFrame:
    """Symbol and edge rows, told apart by ``row_kind``, of (path, text) Python files. Files that do not parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame([r for p, t in zip(b["path"], b["text"], strict=True) for r in python_rows(p, t.replace("\r\n", "\n"))])

    return texts.where(F.length("text") > 0).select("path", "text").mapInPandas(run, SYMBOLS)


def same_file_confidence(rows: DataFrame) -> DataFrame:
    """The edges of ``extract_python`` with EXTRACTED, AMBIGUOUS or INFERRED by the definitions in the same file."""
    counts = rows.where("row_kind = 'symbol'").select("path", F.regexp_extract("name", r"([^.]*)$", 1).alias("target_name")).groupBy("path", "target_name").agg(F.count(F.lit(1)).alias("n"))
    conf = F.when(F.col("n").isNull(), "INFERRED").when(F.col("n") == 1, "EXTRACTED").otherwise("AMBIGUOUS")
    return rows.where("row_kind = 'edge'").join(counts, ["path", "target_name"], "left").select("path", "source_name", "target_name", "kind", "receiver", "line", conf.alias("confidence"))


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, content), lines from 1."""
    return texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "content")).select(key, (F.col("p") + 1).alias("line"), "content")


def comment_markers(texts: DataFrame) -> DataFrame:
    """(path, line, marker) of lines whose comment begins with WHY, HACK, NOTE, TODO or FIXME."""
    found = F.upper(F.regexp_extract("content", r"^\s*(?:#|//|\*|/\*+)\s*(WHY|HACK|NOTE|TODO|FIXME)\b", 1))
    return lines(texts, "path").select("path", "line", found.alias("marker")).where("marker <> ''")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, last_line, parent) of Markdown headings; ``last_line`` is the line before the next
    heading of the same or a higher level, null at the end; ``parent`` the nearest heading above of a higher level."""
    h = lines(docs, "doc_id").select("doc_id", "line", F.length(F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)).alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6}\s+|\s+#+\s*$|\r$", "")).alias("title")).where("level > 0")
    order = Window.partitionBy("doc_id").orderBy("line")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    # six levels, each with its next and last line so far: rows grow with the headings, not with their square
    lines_of = lambda k: F.when(F.col("level") == k, F.col("line"))
    h = h.withColumns({f"n{k}": F.min(lines_of(k)).over(after) for k in range(1, 7)} | {f"b{k}": F.max(lines_of(k)).over(before) for k in range(1, 7)})
    ahead = F.array_min(F.array(*[F.when(F.col("level") >= k, F.col(f"n{k}")) for k in range(1, 7)]))
    above = F.array_max(F.array(*[F.when(F.col("level") > k, F.col(f"b{k}")) for k in range(1, 7)]))
    return h.select("doc_id", "line", "level", "title", (ahead - 1).alias("last_line"), above.alias("parent"))


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, line, ref_kind, value): code spans, relative links and issue numbers, each once a line."""
    rows = lines(docs, "doc_id")
    kinds = (("code", r"`([^`\n]+)`", 1), ("link", r"\]\((?!https?:|mailto:|#)([^)\s]+)\)", 1), ("issue", r"(?<![\w&])#(\d+)\b", 1))
    parts = [rows.select("doc_id", "line", F.lit(k).alias("ref_kind"), F.explode(F.regexp_extract_all("content", F.lit(p), g)).alias("value")) for k, p, g in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def parse_diff(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, is_new, line): the added lines of unified diffs given as (diff_id, text)."""
    rows = lines(diffs, "diff_id")
    upto = Window.partitionBy("diff_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    target = F.when(F.col("content").startswith("+++ "), F.regexp_replace("content", r"^\+\+\+ (?:b/)?", ""))
    old = F.when(F.col("content").startswith("--- "), F.col("content").contains("/dev/null"))
    hunk = F.regexp_extract("content", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    tagged = rows.select("diff_id", "line", "content", F.last(target, True).over(upto).alias("path"), F.last(old, True).over(upto).alias("is_new"), F.when(hunk != "", F.struct(hunk.cast("int").alias("start"), F.col("line").alias("at"))).alias("h"))
    tagged = tagged.withColumn("h", F.last("h", True).over(upto))
    head = F.col("content").rlike(r"^(\+\+\+|---|diff |index |@@|new file|deleted file|similarity|rename)")
    counts = tagged.withColumn("body", ~head & F.col("h").isNotNull() & (F.col("line") > F.col("h.at"))).withColumn("step", F.when(F.col("body") & ~F.col("content").startswith("-"), 1).otherwise(0))
    inside = Window.partitionBy("diff_id", "h.at").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("n", F.sum("step").over(inside))
    return placed.where(F.col("body") & F.col("content").startswith("+")).select("diff_id", "path", "is_new", (F.col("h.start") + F.col("n") - 1).cast("int").alias("line"))
