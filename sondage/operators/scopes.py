"""Names resolved through nested scopes, and what definitions and uses say of each other.

A scope is an interval of its file; scopes nest, and none has both ends of
another. The binding of a name is the innermost scope around its use that
declares it. It is found by one sorted sweep for each name of a file: a scope
that declares it opens and closes, the running sum of both is the depth, and
the binding at depth d is what opened last at that depth. So every table is
sorted twice, whatever the depth, and no use meets a scope that isn't its own.

scopes: path, scope, kind (module, function, class, block, catch, with),
begin, end (after the last). declarations: path, scope, name, kind, at,
exported, private. uses: path, scope, name, at, role (read, write, call),
type_position. Ids of scopes are unique in a file; of repeated declarations of
a name in a scope the first (by ``at``, then kind) counts; nulls in keys match
nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Declarations that may be used above where they stand, and kinds whose place says nothing.
HOISTED = ("var", "function", "import", "global", "nonlocal", "for-variable", "catch-parameter")
CLOSE, OUTSIDE, OPEN, POINT = 0, 1, 2, 3


def nearest(intervals: DataFrame, points: DataFrame, by: list[str], value: str, own: bool = True) -> DataFrame:
    """``points`` with ``value`` of the innermost of the ``intervals`` of equal ``by`` around each, or null.

    A point is an interval too (begin, end), that of the scope it is in; with
    ``own`` an interval equal to it counts as one around it.
    """
    row = F.struct(*[c for c in points.columns if c not in (*by, "begin", "end")])
    what = F.struct(F.col(value).alias("v"))
    held = lambda df, x: df.select(x.alias("x")).schema["x"].dataType

    def event(rows: DataFrame, pos: str, kind: int) -> DataFrame:
        opened = what if kind == OPEN else F.lit(None).cast(held(intervals, what))
        point = row if kind in (OUTSIDE, POINT) else F.lit(None).cast(held(points, row))
        wide = F.lit(None).cast(held(rows, -F.col("end"))) if kind == CLOSE else -F.col("end")
        return rows.select(*by, F.col(pos).alias("pos"), wide.alias("wide"), F.lit(kind).cast("byte").alias("type"), opened.alias("opened"), point.alias("row"))

    # at one place: what closes (null comes first), then the widest scope with its own points, then the next within it
    order = ["pos", "wide", "type"]
    events = event(intervals, "begin", OPEN).unionByName(event(intervals, "end", CLOSE)).unionByName(event(points, "begin", POINT if own else OUTSIDE))
    step = F.when(F.col("type") == OPEN, 1).when(F.col("type") == CLOSE, -1).otherwise(0)
    up_to_here = lambda *keys: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    deep = events.withColumn("depth", F.sum(step).over(up_to_here(*by))).where(F.col("type") != CLOSE)
    found = deep.withColumn("found", F.last("opened", True).over(up_to_here(*by, "depth"))).where(F.col("type") != OPEN)
    ends = [F.col("pos").alias("begin"), (-F.col("wide")).alias("end")]
    return found.select(*by, "row.*", *ends, F.when(F.col("depth") > 0, F.col("found.v")).alias(value))


def _first(declarations: DataFrame) -> DataFrame:
    return declarations.groupBy("path", "scope", "name").agg(F.min(F.struct("at", "kind", "exported", "private")).alias("d")).select("path", "scope", "name", "d.*")


def _placed(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    return rows.join(scopes.select("path", "scope", "begin", "end"), ["path", "scope"])


def resolve(scopes: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses`` with ``declared``: the scope whose declaration each name is bound to, null where there is none."""
    binding = _placed(_first(declarations), scopes).select("path", "name", "begin", "end", F.col("scope").alias("declared"))
    return nearest(binding, _placed(uses, scopes), ["path", "name"], "declared").drop("begin", "end")


def shadowed(scopes: DataFrame, declarations: DataFrame) -> DataFrame:
    """(path, name, inner, outer): declarations whose name a scope further out declares as well, with the nearest such scope."""
    placed = _placed(_first(declarations), scopes).select("path", "name", "scope", "begin", "end")
    outer = nearest(placed.withColumnRenamed("scope", "outer"), placed.withColumnRenamed("scope", "inner"), ["path", "name"], "outer", own=False)
    return outer.where("outer is not null").select("path", "name", "inner", "outer")


def used_before_defined(scopes: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, scope, name, at, used): declarations that are used above where they stand, and the first such use.

    Hoisted kinds don't count, nor uses in a function within the declaring
    scope (they run later) or in a type.
    """
    bound = resolve(scopes, declarations, uses.where("not type_position").select("path", "scope", "name", "at")).where("declared is not null")
    of = scopes.where("kind = 'function'").select("path", "begin", "end", F.struct("scope", "begin", "end").alias("fn"))
    inside = nearest(of, scopes.select("path", "scope", "begin", "end"), ["path"], "fn").select("path", "scope", "fn")
    outer = scopes.select("path", F.col("scope").alias("declared"), F.col("begin").alias("b"), F.col("end").alias("e"))
    later = (F.col("fn.begin") >= F.col("b")) & (F.col("fn.end") <= F.col("e")) & (F.col("fn.scope") != F.col("declared"))
    direct = bound.join(inside, ["path", "scope"]).join(outer, ["path", "declared"]).where(~F.coalesce(later, F.lit(False)))
    first = direct.groupBy("path", F.col("declared").alias("scope"), "name").agg(F.min("at").alias("used"))
    return _first(declarations).where(~F.col("kind").isin(*HOISTED)).join(first, ["path", "scope", "name"]).where("used < at").select("path", "scope", "name", "at", "used")


def unused(scopes: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, scope, name, kind, at): declarations that nothing is bound to.

    Exported ones, parameters that begin with ``_`` and names between double
    underscores don't count.
    """
    bound = resolve(scopes, declarations, uses.select("path", "scope", "name")).where("declared is not null").select("path", F.col("declared").alias("scope"), "name").distinct()
    quiet = F.col("exported") | ((F.col("kind") == "parameter") & F.startswith(F.col("name"), F.lit("_"))) | (F.startswith(F.col("name"), F.lit("__")) & F.endswith(F.col("name"), F.lit("__")))
    return _first(declarations).where(~F.coalesce(quiet, F.lit(False))).join(bound, ["path", "scope", "name"], "left_anti").select("path", "scope", "name", "kind", "at")


def undeclared(scopes: DataFrame, declarations: DataFrame, uses: DataFrame, known: DataFrame) -> DataFrame:
    """(path, name, at): names that nothing around declares and that aren't ``known`` (name) everywhere, once per place."""
    free = resolve(scopes, declarations, uses).where("declared is null").select("path", "name", "at").distinct()
    return free.join(known.select("name").distinct(), "name", "left_anti").select("path", "name", "at")


def private_members(scopes: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, scope, name, written, read, called): private members of classes and what is done to them."""
    classes = scopes.where("kind = 'class'").select("path", "scope")
    # no other name of a file bears on what its private ones are bound to
    names = declarations.where("private").select("path", "name").distinct()
    named = lambda rows: rows.join(names, ["path", "name"], "left_semi")
    members = _first(named(declarations)).where("private").join(classes, ["path", "scope"], "left_semi").select("path", "scope", "name")
    did = lambda role: F.coalesce(F.max(F.col("role") == role), F.lit(False))
    bound = resolve(scopes, named(declarations), named(uses.select("path", "scope", "name", "role"))).where("declared is not null").select("path", F.col("declared").alias("scope"), "name", "role")
    return members.join(bound, ["path", "scope", "name"], "left").groupBy("path", "scope", "name").agg(did("write").alias("written"), did("read").alias("read"), did("call").alias("called"))


def python_scopes(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scopes, declarations, uses) of Python's syntax nodes, as above.

    Functions, lambdas and comprehensions are function scopes. Parameters and
    assigned names are declared in the innermost scope around them; a function's
    or class's own name in the one around it; imported names where they stand.
    """
    functions = ("FunctionDef", "AsyncFunctionDef", "Lambda", "ListComp", "SetComp", "DictComp", "GeneratorExp")
    kind: Column = F.when(F.col("node_type").isin(*functions), "function").when(F.col("node_type") == "ClassDef", "class").when(F.col("node_type") == "Module", "module")
    scopes = nodes.withColumn("k", kind).where("k is not null").select("path", F.col("node").alias("scope"), F.col("k").alias("kind"), F.col("lft").alias("begin"), F.col("rgt").alias("end"))
    around = scopes.select("path", "begin", "end", "scope")

    def within(rows: DataFrame, own: bool) -> DataFrame:
        return nearest(around, rows.withColumn("begin", F.col("lft")).withColumn("end", F.col("rgt")), ["path"], "scope", own=own)

    some = nodes.select("path", "node_type", "context", "name", "detail", "lft", "rgt", F.col("lft").alias("at"))
    local = within(some.where("node_type in ('Name', 'arg', 'Import', 'ImportFrom')"), True)
    outer = within(some.where("node_type in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')"), False)
    names = F.when(F.col("node_type").isin("Import", "ImportFrom"), F.transform(F.split("detail", ","), lambda n: F.element_at(F.split(n, r"\."), 1))).otherwise(F.array("name"))
    bound = local.where("node_type <> 'Name' or context = 'Store'").select("path", "scope", F.explode(names).alias("name"), F.when(F.col("node_type") == "arg", "parameter").when(F.col("node_type") == "Name", "assignment").otherwise("import").alias("kind"), "at")
    named = outer.select("path", "scope", "name", F.when(F.col("node_type") == "ClassDef", "class").otherwise("function").alias("kind"), "at")
    private = F.startswith(F.col("name"), F.lit("_")) & ~F.startswith(F.col("name"), F.lit("__"))
    declarations = bound.unionByName(named).where("name is not null and name <> '*'").select("*", F.lit(False).alias("exported"), private.alias("private"))
    uses = local.where("node_type = 'Name' and context = 'Load'").select("path", "scope", "name", "at", F.lit("read").alias("role"), F.lit(False).alias("type_position"))
    return scopes, declarations, uses
