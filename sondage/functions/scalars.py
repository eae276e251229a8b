"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Severities from worst to least; anything else ranks after them.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Suffixes that enum names carry.
ENUM_SUFFIXES = ("enum", "type", "status", "kind", "values")


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for k, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.lower(severity) == name, k).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` within a segment, ``**`` across segments, ``?`` one sign."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])))
            i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_parameter(segment: Column) -> Column:
    """``:p``, ``<p>``, ``{p}`` and ``[p]`` stand for any segment."""
    return segment.rlike(r"^(:.+|<.+>|\{.+\}|\[.+\])$")


def route_match(url: Column, route: Column) -> Column:
    """Equal numbers of segments, each equal or a parameter on either side."""
    a, b = segments(url), segments(route)
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | is_parameter(x) | is_parameter(y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: x)


def canonical_params(path: Column) -> Column:
    """Route parameters in one spelling: ``:id`` and ``<id>`` become ``{id}``."""
    return F.regexp_replace(F.regexp_replace(path, r":([A-Za-z_]\w*)", r"{$1}"), r"<([A-Za-z_]\w*)>", r"{$1}")


def entity_key(name: Column) -> Column:
    """A table's or entity's last dotted part in lower case, without ``_`` and ``-`` and a plural ``s``."""
    last = F.element_at(F.split(F.lower(name), r"\."), -1)
    return F.regexp_replace(F.regexp_replace(last, "[_-]", ""), "s$", "")


def enum_key(name: Column) -> Column:
    """An enum's name in lower case letters and digits, without a telling suffix."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.regexp_replace(plain, "(" + "|".join(ENUM_SUFFIXES) + ")$", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def value_set_key(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(values, F.lower))), "|")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for an empty text."""
    signs = F.split(text, "")
    n = F.size(signs)
    share = F.transform(F.array_distinct(signs), lambda c: (n - F.size(F.array_remove(signs, c))) / n)
    return F.when(F.length(text) > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards also below zero."""
    return F.floor(x + 0.5)


def relative_path(path: Column, root: str) -> Column:
    """The path without the root and the slash after it; other paths stay."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4)
