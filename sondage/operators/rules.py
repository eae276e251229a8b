"""Rules as data: a rule is a row with the node types it looks at and a condition in SQL.

All rules run in one pass: nodes meet the rules of their type by an equi join
on a table as small as the catalogue, and each rule's condition is one branch
of a single expression. Adding a rule adds a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: key, severity, node types, condition over a node's columns, title
RULES = (
    ("bugs/bare-except", "medium", ("ExceptHandler",), "name IS NULL", "Exception handler without a type"),
    ("bugs/swallowed-exception", "medium", ("ExceptHandler",), "detail = 'pass'", "Exception is dropped"),
    ("bugs/mutable-default", "high", ("FunctionDef", "AsyncFunctionDef"), "detail = 'mutable-default'", "Mutable default argument"),
    ("bugs/compare-to-none", "low", ("Compare",), "detail RLIKE '(^|,)(Eq|NotEq):None'", "Comparison with None by value"),
    ("bugs/unparsable-file", "high", ("Error",), "true", "File can't be parsed"),
    ("security/eval-call", "critical", ("Call",), "name IN ('eval', 'exec')", "Dynamic evaluation"),
    ("security/shell-call", "critical", ("Call",), "name RLIKE '^(os\\\\.(system|popen)|subprocess\\\\.(run|call|Popen|check_output))$' AND (name LIKE 'os.%' OR detail LIKE '%shell=True%')", "Command goes through a shell"),
    ("security/unsafe-yaml", "high", ("Call",), "name = 'yaml.load' AND NOT coalesce(detail, '') LIKE '%Loader=%'", "Unsafe YAML loading"),
    ("security/weak-hash", "medium", ("Call",), "name IN ('hashlib.md5', 'hashlib.sha1')", "Weak hash function"),
    ("code-quality/star-import", "low", ("ImportFrom",), "detail = '*'", "Import of everything"),
    ("code-quality/print-call", "info", ("Call",), "name = 'print'", "Print in code"),
    ("code-quality/global-statement", "low", ("Global",), "true", "Global variable is changed"),
    ("architecture/long-method", "low", ("FunctionDef", "AsyncFunctionDef"), "statements > 30", "Function is too long"),
    ("architecture/too-many-parameters", "low", ("FunctionDef", "AsyncFunctionDef"), "params > 5", "Too many parameters"),
    ("architecture/deeply-nested-logic", "medium", ("FunctionDef", "AsyncFunctionDef"), "nesting > 4", "Logic is nested too deeply"),
)


def run_rules(nodes: DataFrame, rules=RULES, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(rule_key, severity, title, path, line_start, line_end, symbol): what each enabled rule finds.

    A node's findings are those of its type's rules whose condition holds; the
    filter on node types comes first, so that other nodes are dropped in the scan.
    """
    live = [r for r in rules if r[0] not in disabled]
    types = sorted({t for r in live for t in r[2]})
    found = F.array(*[
        F.when(F.col("node_type").isin(*r[2]) & F.coalesce(F.expr(r[3]), F.lit(False)), F.struct(F.lit(r[0]).alias("rule_key"), F.lit(r[1]).alias("severity"), F.lit(r[4]).alias("title"))) for r in live
    ]) if live else F.array().cast("array<struct<rule_key:string,severity:string,title:string>>")
    hit = nodes.where(F.col("node_type").isin(*types)).withColumn("f", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return hit.select("f.rule_key", "f.severity", "f.title", "path", "line_start", "line_end", F.col("name").alias("symbol"))


def inside(nodes: DataFrame, inner: str, outer: tuple[str, ...], width: int = 256) -> DataFrame:
    """Nodes of one type with the innermost node of the outer types that encloses them.

    The interval of an ancestor encloses its descendants', and the deepest
    ancestor wins. Intervals go to the stretches of ``width`` places that they
    cover, so that a node meets only those around it and not all of its file.
    """
    a = nodes.where(F.col("node_type") == inner).select("path", "node", F.col("lft").alias("at"), F.floor(F.col("lft") / width).alias("stretch"))
    b = nodes.where(F.col("node_type").isin(*outer)).select("path", F.col("node").alias("outer"), "lft", "rgt", "depth", F.explode(F.sequence(F.floor(F.col("lft") / width), F.floor(F.col("rgt") / width))).alias("stretch"))
    return a.join(b, ["path", "stretch"]).where("lft < at and at < rgt").groupBy("path", "node").agg(F.max_by("outer", "depth").alias("outer"))


def context_batches(files: DataFrame, most_chars: int = 100_000, lanes: int = 64) -> DataFrame:
    """(path, lane, batch): files in batches of at most ``most_chars``, filled in order of path within a lane.

    A single longer file is a batch of its own. Lanes are dealt by hash, so
    that no task holds all files. A batch's number is that of the running
    sum's step, which keeps each batch within twice the limit and most within it.
    """
    laned = files.select("path", F.char_length("text").alias("n"), F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int").alias("lane"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lane").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return laned.select("path", "lane", "n", F.floor((before + F.least("n", F.lit(most_chars)) - 1) / most_chars).alias("batch"))
