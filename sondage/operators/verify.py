"""Comparators of entities, authorization, formulas, query rules and enum subsets, and what becomes of their drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: An operator as it reads from the other side.
FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "==": "==", "!=": "!="}
#: Fixed value: the subset whose values may be absent in code.
ELSEWHERE = "cloud-only"


def entity_drifts(fields: DataFrame, assignments: DataFrame, constructions: DataFrame, lowering: DataFrame) -> DataFrame:
    """(entity, field, obligation, file, line): immutable fields that are assigned, lower-case fields never lowered.

    fields: entity, field, immutable, lowercase. An assignment (file, receiver,
    field, line) counts if its receiver's name holds the entity's. A file that
    constructs an entity (file, entity, field; a null field is any) and is not
    among the files of ``lowering`` never lowers a value. Equal rows count once.
    """
    fixed = fields.where("immutable").select("entity", "field")
    written = assignments.join(fixed, "field").where(F.contains(F.lower("receiver"), F.lower("entity")))
    a = written.select("entity", "field", F.lit("mutability").alias("obligation"), "file", F.col("line").cast("int").alias("line"))
    made = constructions.select("entity", "file", F.col("field").alias("made")).join(fields.where("lowercase").select("entity", "field"), "entity")
    b = made.where("made is null or made = field").join(lowering.select("file").distinct(), "file", "left_anti").select("entity", "field", F.lit("normalize").alias("obligation"), "file", F.lit(1).alias("line"))
    return a.unionByName(b).distinct()


def authorization_drifts(rules: DataFrame, handlers: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Rules (operation, field) whose handler compares the field with nothing; without a known handler nothing is said."""
    known = rules.join(handlers.select("operation").distinct(), "operation", "left_semi")
    return known.join(comparisons.select("operation", "field").distinct(), ["operation", "field"], "left_anti").distinct()


def numeric_constraints(text: Column) -> Column:
    """An array of (op, literal) of a formula's comparisons with whole numbers; a number before the operator is flipped."""
    op = r"(>=|<=|==|!=|>|<)"
    after, before = rf"[A-Za-z_]\w*\s*{op}\s*(-?\d+)", rf"(-?\d+)\s*{op}\s*[A-Za-z_]\w*"
    flip = F.create_map(*[F.lit(x) for pair in FLIPPED.items() for x in pair])
    first = F.zip_with(F.regexp_extract_all(text, F.lit(after), F.lit(1)), F.regexp_extract_all(text, F.lit(after), F.lit(2)), lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("literal")))
    last = F.zip_with(F.regexp_extract_all(text, F.lit(before), F.lit(2)), F.regexp_extract_all(text, F.lit(before), F.lit(1)), lambda o, n: F.struct(F.element_at(flip, o).alias("op"), n.cast("long").alias("literal")))
    return F.array_distinct(F.concat(first, last))


def formula_drifts(spec: DataFrame, code: DataFrame, inputs: DataFrame) -> DataFrame:
    """(formula, drift, what): numbers compared by another operator, and inputs that the code doesn't read.

    spec: formula, text; code: formula, text (no row: nothing is known, nothing
    is said); inputs: formula, name, referenced. A name that begins with an
    underscore counts as unread.
    """
    known = code.select("formula").distinct()
    want = spec.join(known, "formula", "left_semi").select("formula", F.explode(numeric_constraints(F.col("text"))).alias("c")).select("formula", "c.literal", F.col("c.op").alias("op"))
    have = code.select("formula", F.explode(numeric_constraints(F.col("text"))).alias("c")).select("formula", "c.literal", "c.op").groupBy("formula", "literal").agg(F.collect_set("op").alias("ops"))
    other = want.join(have, ["formula", "literal"]).where(~F.array_contains("ops", F.col("op"))).select("formula", F.lit("operator-mismatch").alias("drift"), F.concat_ws(" ", "op", F.col("literal").cast("string")).alias("what"))
    unread = inputs.join(known, "formula", "left_semi").where(F.startswith("name", F.lit("_")) | ~F.col("referenced")).select("formula", F.lit("input-unread").alias("drift"), F.col("name").alias("what"))
    return other.unionByName(unread).distinct()


def forbidden_predicates(forbidden: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, column, query_id): queries with a predicate that must not be there; lists of values are sets."""
    as_set = F.array_sort(F.array_distinct("values"))
    no = forbidden.select("entity", "column", "kind", as_set.alias("v")).distinct()
    return found.select("entity", "column", "kind", "query_id", as_set.alias("v")).join(no, ["entity", "column", "kind", "v"]).select("entity", "column", "query_id").distinct()


def query_rule_notes(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """(entity, query_id, drift, severity): queries without the range on a rule's date column, and unreadable ones.

    rules: entity, date_column (null: none); queries: entity, query_id,
    date_column, unparseable. An unreadable query is noted, not judged.
    """
    joined = queries.join(rules.select("entity", F.col("date_column").alias("wanted")), "entity")
    drift = F.when(F.col("unparseable"), "unparseable").when(F.col("wanted").isNotNull() & ~F.col("date_column").eqNullSafe(F.col("wanted")), "date-binding")
    severity = F.when(F.col("unparseable"), "info").otherwise("medium")
    return joined.select("entity", "query_id", drift.alias("drift"), severity.alias("severity")).where("drift is not null")


def united_copies(code: DataFrame) -> DataFrame:
    """Enums of one name as one, with the values of all copies."""
    return code.groupBy("code_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("code_values")))).alias("code_values"))


def subset_drifts(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(name, subset, value): values of a named subset that the code's enum lacks, but for values that live elsewhere."""
    rows = spec.where(F.col("subset") != ELSEWHERE).select("name", "subset", F.explode("values").alias("value"))
    have = united_copies(code).select(F.col("code_name").alias("name"), F.explode("code_values").alias("value"))
    known = code.select(F.col("code_name").alias("name")).distinct()
    return rows.join(known, "name", "left_semi").join(have, ["name", "value"], "left_anti").select("name", "subset", "value").distinct()


def as_findings(drifts: DataFrame, origins: DataFrame) -> DataFrame:
    """Drifts as findings: a rule key by kind and obligation, and the place in the documents where the claim stands.

    Obligations that can't be enforced are carried as they are and never become findings.
    """
    told = drifts.where("not unenforceable").join(origins.select("artifact", "source", F.col("line").alias("source_line")), "artifact", "left")
    return told.select(
        "id", F.concat_ws("/", F.lit("contract-drift"), F.lower("kind"), "obligation").alias("rule_key"), "severity", "file_path", "line_start",
        F.coalesce(F.concat_ws(":", F.col("source"), F.col("source_line").cast("string")), F.lit("")).alias("origin"),
    )


def diff_decisions(head: DataFrame, base: DataFrame | None, dropped: DataFrame | None = None) -> DataFrame:
    """(kind, identity, change): decisions added, changed in their text, or resolved; without a base all are added.

    Dismissed and promoted ones (kind, identity) are left out of the head first.
    """
    keys = ["kind", "identity"]
    now = head if dropped is None else head.join(dropped.select(*keys).distinct(), keys, "left_anti")
    if base is None:
        return now.select(*keys, F.lit("added").alias("change"))
    both = now.select(*keys, F.col("body").alias("h"), F.lit(1).alias("inh")).join(base.select(*keys, F.col("body").alias("b"), F.lit(1).alias("inb")), keys, "full_outer")
    change = F.when(F.col("inb").isNull(), "added").when(F.col("inh").isNull(), "resolved").when(~F.col("h").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")
