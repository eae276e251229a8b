"""Classifiers and predicates over paths and texts, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sondage.functions.scalars import glob_match

#: Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "cs": "csharp"}
MINIFIED_BYTES, MINIFIED_HEAD, MINIFIED_LINES = 15 * 1024, 8 * 1024, 4
GENERATED_HEAD = 400


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1)))


def looks_minified(text: Column) -> Column:
    """A long text with next to no line ends at its beginning."""
    head = F.substring(text, 1, MINIFIED_HEAD)
    return (F.octet_length(text) >= MINIFIED_BYTES) & (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) < MINIFIED_LINES)


def is_generated(path: Column, text: Column) -> Column:
    return path.rlike(r"\.(g|generated|designer)\.[a-z]+$") | F.contains(F.lower(F.substring(text, 1, GENERATED_HEAD)), F.lit("<auto-generated"))


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$")


def doc_kind(path: Column, text: Column) -> Column:
    """The first rule that fits: by file name, then directory, then content."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.rlike("spec") | path.rlike("(^|/)specs?/"), "spec").when(name.rlike("^adr[-_]?[0-9]*") | path.rlike("(^|/)adrs?/"), "adr")
        .when(name.rlike("^rfc") | path.rlike("(^|/)rfcs?/"), "rfc").when(name.rlike("prd"), "prd").when(name.rlike("runbook"), "runbook")
        .when(name.rlike("^readme"), "readme").when(F.lower(text).contains("design"), "design-note").otherwise("unknown")
    )


def selector(tree: dict, path: Column, method: Column, tags: Column) -> Column:
    """A selector tree as one condition; one compiler for every kind of contract."""
    kind = tree["kind"]
    parts = [selector(t, path, method, tags) for t in tree.get("of", [])]
    if kind == "path-glob":
        return glob_match(path, tree["value"])
    if kind == "path-exact":
        return path == tree["value"]
    if kind == "path-regex":
        return path.rlike(tree["value"])
    if kind == "method":
        return F.upper(method) == tree["value"].upper()
    if kind == "tag":
        return F.array_contains(tags, tree["value"])
    if kind == "not":
        return ~parts[0]
    out = F.lit(kind != "any-of")
    for p in parts:
        out = out | p if kind == "any-of" else out & (~p if kind == "none-of" else p)
    return out


def layers(imports: Column, path: Column, routes: Column) -> Column:
    """The layers a file belongs to, as a sorted array; a file of none is a service's."""
    data = F.exists(imports, lambda i: i.isin("prisma", "sqlalchemy", "knex", "typeorm", "dapper"))
    api = F.exists(imports, lambda i: i.isin("express", "fastapi", "flask", "koa")) | (path.rlike("(^|/)(api|routes?|controllers?)/") & (routes > 0))
    external = F.exists(imports, lambda i: i.isin("axios", "requests", "httpx", "stripe", "kafkajs"))
    found = F.filter(F.array(F.when(api, "api"), F.when(data, "data"), F.when(external, "external")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("service")))
