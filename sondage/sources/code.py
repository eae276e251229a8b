"""Sources of code facts: files, Python syntax trees, import edges, SQL predicates, schemas and manifests."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sondage.functions.scalars import glob_match
from sondage.operators.classify import is_generated, language, looks_minified

#: Directories that hold no source of a project's own.
SKIPPED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/__pycache__/**", "**/bin/**", "**/obj/**")


def read_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = SKIPPED, pattern: str = "*") -> DataFrame:
    """(path, text, bytes): the text files below ``root`` that aren't ignored, whatever store holds them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = found.select("path", F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))
    for g in ignored:
        rows = rows.where(~glob_match(F.col("path"), g))
    return rows


def code_files(files: DataFrame) -> DataFrame:
    """Files of a known language that are neither minified nor generated."""
    rows = files.withColumn("language", language(F.col("path")))
    return rows.where(F.col("language").isNotNull() & ~looks_minified(F.col("text")) & ~is_generated(F.col("path"), F.col("text")))


NODES = "path string, node int, parent int, lft int, rgt int, depth int, node_type string, name string, detail string, line_start int, line_end int, column int, params int, statements int, nesting int, context string"

BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def _name(n: ast.AST) -> str | None:
    if isinstance(n, ast.Call):
        return _dotted(n.func)
    if isinstance(n, ast.ImportFrom):
        return "." * n.level + (n.module or "")
    if isinstance(n, ast.ExceptHandler):
        return _dotted(n.type) if n.type is not None else None
    return getattr(n, "name", None) or getattr(n, "attr", None) or getattr(n, "id", None) or getattr(n, "arg", None)


def _dotted(n: ast.AST) -> str | None:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([*([n.id] if isinstance(n, ast.Name) else []), *reversed(parts)]) or None


def _detail(n: ast.AST) -> str | None:
    if isinstance(n, ast.Import | ast.ImportFrom):
        return ",".join(a.name for a in n.names)
    if isinstance(n, ast.Constant):
        return f"{type(n.value).__name__}:{n.value!r}"[:200]
    if isinstance(n, ast.Compare):
        return ",".join(type(o).__name__ + (":None" if isinstance(c, ast.Constant) and c.value is None else "") for o, c in zip(n.ops, n.comparators, strict=True))
    if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
        defaults = [*n.args.defaults, *(d for d in n.args.kw_defaults if d is not None)]
        return "mutable-default" if any(isinstance(d, ast.List | ast.Dict | ast.Set) for d in defaults) else None
    if isinstance(n, ast.ExceptHandler):
        return "pass" if len(n.body) == 1 and isinstance(n.body[0], ast.Pass) else None
    if isinstance(n, ast.Call):
        return ",".join(sorted(f"{k.arg}={ast.unparse(k.value)}" for k in n.keywords if k.arg))[:200]
    return None


def python_nodes(path: str, text: str) -> list[tuple]:
    """The nodes of one file in preorder; (lft, rgt) encloses a node's descendants. An unreadable file has one ``Error`` node."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, 0, None, 0, 0, 0, "Error", type(e).__name__, None, getattr(e, "lineno", None) or 1, getattr(e, "lineno", None) or 1, 0, None, None, None, None)]
    out, stack, clock = [], [(tree, None, 0, False)], 0
    while stack:
        n, parent, depth, leaving = stack.pop()
        if leaving:
            out[parent][4] = clock
            continue
        at = len(out)
        fn = isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)
        params = len(n.args.posonlyargs) + len(n.args.args) + len(n.args.kwonlyargs) if fn else None
        statements = sum(isinstance(x, ast.stmt) for x in ast.walk(n)) - 1 if fn else None
        out.append([path, at, parent, clock, None, depth, type(n).__name__, _name(n), _detail(n), getattr(n, "lineno", None), getattr(n, "end_lineno", None), getattr(n, "col_offset", None), params, statements, _nesting(n) if fn else None, "arg" if isinstance(n, ast.arg) else type(n.ctx).__name__ if isinstance(n, ast.Name) else None])
        clock += 1
        stack.append((n, at, depth, True))
        stack += [(c, at, depth + 1, False) for c in reversed(list(ast.iter_child_nodes(n)))]
    return [tuple(r) for r in out]


def _nesting(n: ast.AST) -> int:
    return max((int(isinstance(c, BLOCKS)) + _nesting(c) for c in ast.iter_child_nodes(n) if not isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda)), default=0)


def parse_python(files: DataFrame) -> DataFrame:
    """The syntax nodes of every Python file, parsed in its own partition; nothing is shuffled."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in NODES.split(", ")]
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in python_nodes(p, t or "")]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "text").mapInPandas(run, NODES)


def functions_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin("FunctionDef", "AsyncFunctionDef")).select("path", "node", "name", "line_start", "line_end", "params", "statements", "nesting", (F.col("node_type") == "AsyncFunctionDef").alias("is_async"))


def calls_of(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'Call' and name is not null").select("path", "node", F.col("name").alias("callee"), F.col("line_start").alias("line"))


def import_edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): imports that name a file of the project: the module itself, then its package, then its parent.

    Each import gives its candidates in order; an equi join on the module name
    finds files, and the first candidate that is one wins.
    """
    plain = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "")
    # a file's dotted name has as many beginnings as its path has parts
    parts = F.split(plain, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    known = files.where(F.col("path").endswith(".py")).select(F.col("path").alias("target"), F.explode(tails).alias("module"))
    found = nodes.where(F.col("node_type").isin("Import", "ImportFrom"))
    up = F.length(F.regexp_extract("name", r"^\.*", 0))
    here = F.split("path", "/")
    package = F.array_join(F.slice(here, F.lit(1), F.greatest(F.size(here) - up, F.lit(0))), ".")
    own = F.regexp_replace("name", r"^\.+", "")
    base = F.when(up > 0, F.concat_ws(".", F.when(package != "", package), F.when(own != "", own))).otherwise(own)
    named = found.select("path", "node", F.explode(F.split("detail", ",")).alias("what"), F.when(F.col("node_type") == "ImportFrom", base).alias("base"))
    candidates = F.filter(F.array(F.when(F.col("base").isNotNull(), F.concat_ws(".", "base", "what")).otherwise(F.col("what")), F.col("base")), lambda x: x.isNotNull())
    tried = named.select(F.col("path").alias("source"), "node", "what", F.posexplode(candidates).alias("k", "module"))
    hit = tried.join(known, "module").where("source <> target")
    best = hit.groupBy("source", "node", "what").agg(F.min_by("target", F.struct("k", F.length("target"), "target")).alias("target"))
    return best.groupBy("source", "target").agg(F.array_sort(F.collect_set("what")).alias("imported_names"))


#: Comparison signs of SQL by name.
OPERATORS = {"=": "eq", "<>": "neq", "!=": "neq", ">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}
PREDICATE = "query_id string, kind string, table string, column string, values array<string>, raw string"


def split_ands(where: str) -> list[str]:
    """The parts of a condition between its outermost ANDs; the AND of a BETWEEN stays inside."""
    parts, depth, start, pending, quote = [], 0, 0, False, False
    for m in re.finditer(r"'|\(|\)|\bBETWEEN\b|\bAND\b", where, re.I):
        t = m.group().upper()
        if t == "'":
            quote = not quote
        elif quote:
            continue
        elif t in "()":
            depth += 1 if t == "(" else -1
        elif depth == 0 and t == "BETWEEN":
            pending = True
        elif depth == 0 and t == "AND":
            if pending:
                pending = False
                continue
            parts.append(where[start : m.start()])
            start = m.end()
    return [p.strip() for p in [*parts, where[start:]] if p.strip()]


def _value(text: str) -> str:
    """A literal with its kind: ``s:`` string, ``n:`` number, ``b:`` boolean, ``z:`` null, ``p:`` parameter, ``i:`` name."""
    t = text.strip()
    if t.startswith("'") and t.endswith("'"):
        return "s:" + t[1:-1].replace("''", "'")
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", t):
        return "n:" + t
    if t.lower() in ("true", "false"):
        return "b:" + t.lower()
    if t.lower() == "null":
        return "z:"
    return ("p:" if re.fullmatch(r"\?|[:@$%].*", t) else "i:") + t


def _column(text: str) -> tuple[str | None, str]:
    table, _, column = text.strip().strip('"`').rpartition(".")
    return table or None, column.strip('"`')


def parse_predicate(text: str) -> tuple[str, str | None, str | None, list[str]]:
    """(kind, table, column, values); what isn't understood is ``raw``."""
    name = r"([\w.\"`]+)"
    for pattern, kind in ((rf"{name}\s+IS\s+NULL", "is-null"), (rf"{name}\s+IS\s+NOT\s+NULL", "is-not-null")):
        if m := re.fullmatch(pattern, text, re.I):
            return kind, *_column(m[1]), []
    if m := re.fullmatch(rf"{name}\s+(NOT\s+)?IN\s*\((.*)\)", text, re.I | re.S):
        if not re.match(r"\s*SELECT\b", m[3], re.I):
            return "not-in" if m[2] else "in", *_column(m[1]), [_value(v) for v in re.findall(r"\s*('(?:[^']|'')*'|[^,]+)", m[3])]
    if m := re.fullmatch(rf"{name}\s+BETWEEN\s+(.+?)\s+AND\s+(.+)", text, re.I | re.S):
        return "between", *_column(m[1]), [_value(m[2]), _value(m[3])]
    if m := re.fullmatch(rf"{name}\s+(I?LIKE)\s+(.+)", text, re.I | re.S):
        return m[2].lower(), *_column(m[1]), [_value(m[3])]
    if m := re.fullmatch(rf"{name}\s*(=|<>|!=|>=|<=|>|<)\s*('(?:[^']|'')*'|[\w.:@$%?+-]+)", text, re.S):
        value = _value(m[3])
        kind = "column-compare" if value.startswith("i:") else OPERATORS[m[2]]
        return kind, *_column(m[1]), [value]
    return "raw", None, None, []


def sql_predicates(queries: DataFrame) -> DataFrame:
    """(query_id, kind, table, column, values, raw): the predicates of each statement's WHERE, one row each."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for q, sql in zip(pdf["query_id"], pdf["sql"], strict=True):
                base = re.search(r"\bFROM\s+([\w.\"`]+)", sql or "", re.I)
                where = re.search(r"\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|;|$)", sql or "", re.I | re.S)
                for part in split_ands(where[1]) if where else []:
                    kind, table, column, values = parse_predicate(part)
                    rows.append((q, kind, table or (base[1] if base and column else None), column, values, part if kind == "raw" else None))
            yield pd.DataFrame(rows, columns=["query_id", "kind", "table", "column", "values", "raw"])

    return queries.select(F.col("query_id").cast("string"), "sql").mapInPandas(run, PREDICATE)


def prisma_columns(files: DataFrame) -> DataFrame:
    """(table, column, type, optional, many): the fields of the models in Prisma schemas, by expressions alone."""
    models = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)model\s+\w+\s*\{.*?\n\}"), F.lit(0))).alias("m"))
    fields = models.select(F.regexp_extract("m", r"model\s+(\w+)", 1).alias("table"), F.explode(F.split("m", "\n")).alias("l"))
    parsed = fields.select("table", *[F.regexp_extract("l", r"^\s+(\w+)\s+(\w+)(\[\])?(\?)?", k).alias(n) for k, n in ((1, "column"), (2, "type"), (3, "many"), (4, "optional"))])
    return parsed.where("column <> ''").select("table", "column", "type", (F.col("optional") == "?").alias("optional"), (F.col("many") == "[]").alias("many"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, dependency): from package.json and requirements.txt."""
    name = F.element_at(F.split("path", "/"), -1)
    js = files.where(name == "package.json").select("path", F.explode(F.map_keys(F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")]))).alias("dependency"))
    py = files.where(name == "requirements.txt").select("path", F.explode(F.split("text", "\n")).alias("l")).select("path", F.lower(F.regexp_extract("l", r"^\s*([A-Za-z0-9_.-]+)", 1)).alias("dependency")).where("dependency <> ''")
    return js.unionByName(py).distinct()


def markdown_blocks(files: DataFrame) -> DataFrame:
    """(path, block, heading, level, text, id): a file's text cut at its headings."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("k", "l"))
    level = F.length(F.regexp_extract("l", r"^(#{1,6})\s", 1))
    w = W.partitionBy("path").orderBy("k")
    cut = lines.withColumn("level", level).withColumn("block", F.sum((F.col("level") > 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda x: x["l"]), "\n")
    return cut.groupBy("path", "block").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.regexp_replace("l", r"^#{1,6}\s+", ""))).alias("heading"), body.alias("text")).withColumn("id", F.sha2(F.col("text").cast("binary"), 256))
