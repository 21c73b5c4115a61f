"""Scalar expressions on names, paths, routes, keys and texts; all of them plain JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: kinds that hold members, confidence ranks, and the tiers of distance
CONTAINERS = ("class", "interface", "struct")
RANKS = {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2}


def split_identifier(c: Column) -> Column:
    """The distinct lower-case words of an identifier, by separators and both camel-case boundaries, in order."""
    apart = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", r"$1 $2"), r"([A-Z]+)([A-Z][a-z])", r"$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(apart), r"[^a-z0-9]+"), lambda x: x != ""))


def search_text(name: Column, qualified: Column) -> Column:
    """The words of a name and its qualified name, joined by blanks."""
    return F.array_join(F.array_distinct(F.concat(split_identifier(name), F.coalesce(split_identifier(qualified), F.array().cast("array<string>")))), " ")


def bare_name(c: Column) -> Column:
    """The part after the last dot."""
    return F.regexp_extract(c, r"([^.]*)$", 1)


def owner_name(c: Column) -> Column:
    """The part before the last dot; null where there is none."""
    owner = F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    return F.when(owner != "", owner)


def uid(path: Column, line: Column) -> Column:
    """First eight hexadecimal digits of the path's SHA-1, and the line."""
    return F.concat_ws(":", F.substring(F.sha1(path), 1, 8), line.cast("string"))


def shared_folders(a: Column, b: Column) -> Column:
    """How many leading folders two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n > 0) & (F.slice(x, 1, i) == F.slice(y, 1, i)), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, v: s + v)


def normal_route(c: Column) -> Column:
    """A route with one leading slash, parameters as {param} and no doubled or trailing slashes."""
    r = F.regexp_replace(F.concat(F.lit("/"), F.trim(c)), r"(:[A-Za-z_]\w*|<[^>]+>|\{[^}]+\}|\$\{[^}]+\})", "{param}")
    r = F.regexp_replace(r, r"/+", "/")
    return F.when(F.length(r) > 1, F.regexp_replace(r, r"/$", "")).otherwise(r)


def normal_key(c: Column) -> Column:
    """A configuration key in upper case with underscores."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def value_category(c: Column) -> Column:
    """empty, boolean, number, url, placeholder or present; null for null."""
    t = F.lower(F.trim(c))
    return (
        F.when(c.isNull(), F.lit(None).cast("string")).when(t == "", "empty").when(t.isin("true", "false", "yes", "no", "on", "off"), "boolean").when(t.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(t.rlike(r"^[a-z][a-z0-9+.-]*://"), "url").when(t.rlike(r"^<.*>$|^\$\{.*\}$|^(changeme|todo|xxx|your[_-].*)$"), "placeholder").otherwise("present")
    )


def is_test_path(path: Column) -> Column:
    """By folder or file name: a folder test or tests, conftest.py, test_*.py, *_test.py, *.spec.* and *.test.* of scripts."""
    return path.rlike(r"(^|/)tests?/|(?i:(^|/)conftest\.py$|(^|/)test_[^/]*\.py$|_test\.py$|\.(spec|test)\.[jt]sx?$)")


def is_test_path_narrow(path: Column) -> Column:
    """The narrower rule that search and suspects use; false for null."""
    return F.coalesce(F.lower(F.regexp_replace(path, r"\\", "/")).rlike(r"(^|/)tests?/|_test\.py$|\.(test|spec)\.[jt]s$"), F.lit(False))


def tier(distance: Column) -> Column:
    """The risk tier of a distance in hops."""
    return F.when(distance <= 1, "will_break").when(distance == 2, "likely_affected").otherwise("may_need_testing")


def confidence_of(count: Column) -> Column:
    """EXTRACTED for one definition, AMBIGUOUS for several, INFERRED for none."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, "INFERRED").when(count == 1, "EXTRACTED").otherwise("AMBIGUOUS")


def token_estimate(c: Column) -> Column:
    """Characters divided by four, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; the asterisk crosses slashes, case counts."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_/" else c)
        i += 1
    return "".join([*out, "$"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where a length is 0, null where sizes differ or one is null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    sq = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sq(a) * sq(b)
    return F.when(F.size(a) == F.size(b), F.when(length == 0, 0.0).otherwise(dot / length))
