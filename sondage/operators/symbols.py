"""Edges of files by the types that they name, in languages whose names are found through namespaces.

A plain name is looked for in the namespaces that its file sees: its own and
all around them, those it uses, and those its project uses everywhere. It meets
types by name and namespace at once, so a name that many namespaces have brings
only those together that a file sees. A dotted name, or an alias, goes by the
longest part that names a type. Of types in several namespaces those of the
nearest project count; if these still are of several, the name is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _prefixes(path: Column) -> Column:
    """A dotted path and all that it begins with, at whole segments."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def visible_namespaces(files: DataFrame, declared: DataFrame, usings: DataFrame) -> DataFrame:
    """(file, namespace): what each file sees; every file sees the nameless one."""
    own = declared.where("namespace <> ''").select("file", F.explode(_prefixes(F.col("namespace"))).alias("namespace"))
    plain = usings.where("alias is null and not is_static")
    project = F.coalesce("project", F.lit("")).alias("p")
    everywhere = plain_globals(usings).join(files.select("file", project), "file").select("p", "target").distinct()
    of_project = files.select("file", project).join(everywhere, "p").select("file", F.col("target").alias("namespace"))
    return own.unionByName(files.select("file", F.lit("").alias("namespace"))).unionByName(plain.select("file", F.col("target").alias("namespace"))).unionByName(of_project).distinct()


def plain_globals(usings: DataFrame) -> DataFrame:
    return usings.where("is_global").select("file", "target")


def candidates(seen: DataFrame, placed: DataFrame, project_refs: DataFrame, open_to: Column) -> DataFrame:
    """(file, name, namespace, visibility, b, rank): what plain names may mean, by namespace and project (b), however many files declare it there.

    seen: file, name, namespace, a (the file's project); placed: type,
    namespace, visibility, b and others. The files come in once it is known
    which of these counts.
    """
    spots = placed.select(F.col("type").alias("name"), "namespace", "visibility", "b").distinct()
    near = project_refs.select(F.col("project").alias("a"), F.col("referenced").alias("b")).distinct().withColumn("near", F.lit(True))
    rank = F.when(F.col("a") == F.col("b"), 0).when(F.col("near"), 1).otherwise(2)
    rows = seen.join(spots, ["name", "namespace"]).where(open_to).join(near, ["a", "b"], "left")
    return rows.select("file", "name", "namespace", "visibility", "b", F.coalesce(rank, F.lit(2)).alias("rank"))


def resolved(types: DataFrame, files: DataFrame, declared: DataFrame, usings: DataFrame, refs: DataFrame, project_refs: DataFrame) -> DataFrame:
    """(file, name, target, type): the files whose types each name means; an ambiguous or unknown name has no row.

    types: name, namespace, file, visibility (others than ``public`` are seen in
    their project alone, where both projects are known); files: file, project or
    null; declared: file, namespace; usings: file, target, alias, is_static,
    is_global; refs: file, name; project_refs: project, referenced. The target
    of a static using is a name too. Repeated rows count once.
    """
    asked = refs.select("file", "name").unionByName(usings.where("alias is null and is_static").select("file", F.col("target").alias("name"))).distinct()
    alias = usings.where("alias is not null").groupBy("file", F.col("alias").alias("head")).agg(F.max("target").alias("aliased"))
    head = F.element_at(F.split("name", r"\."), 1)
    asked = asked.withColumn("head", head).join(alias, ["file", "head"], "left").withColumn("dotted", F.contains(F.col("name"), F.lit(".")))
    path = F.when(F.col("aliased").isNull(), F.col("name")).otherwise(F.concat("aliased", F.substr("name", F.length("head") + 1)))
    asked = asked.select("file", "name", path.alias("path"), (F.col("dotted") | F.col("aliased").isNotNull()).alias("whole"))
    full = types.select(F.col("name").alias("type"), "namespace", F.col("file").alias("target"), "visibility", F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat_ws(".", "namespace", "name")).alias("full")).distinct()
    parts = asked.where("whole").select("file", "name", F.explode(_prefixes(F.col("path"))).alias("full")).withColumn("length", F.length("full"))
    known = parts.join(full.select("full").distinct(), "full", "left_semi")
    longest = known.groupBy("file", "name").agg(F.max_by("full", "length").alias("full"))
    source = files.select("file", F.col("project").alias("a"))
    placed = full.join(files.select(F.col("file").alias("target"), F.col("project").alias("b")), "target", "left")
    open_to = (F.col("visibility") == "public") | F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))
    found = longest.join(placed, "full").join(source, "file", "left").where(open_to).select("file", "name", "target", "type")
    seen = asked.where("not whole").select("file", "name").join(visible_namespaces(files, declared, usings), "file").join(source, "file", "left")
    ranked = candidates(seen, placed, project_refs, open_to)
    spaces = ranked.groupBy("file", "name", "rank").agg(F.count_distinct("namespace").alias("spaces"), F.min("namespace").alias("least"))
    best = spaces.groupBy("file", "name").agg(F.min(F.struct("rank", "spaces")).alias("b"), F.min("least").alias("low"), F.max("least").alias("high"), F.max("spaces").alias("most"))
    # one namespace in all ranks, or else one in the nearest rank
    best = best.select("file", "name", F.when((F.col("low") == F.col("high")) & (F.col("most") == 1), 2).when(F.col("b.spaces") == 1, F.col("b.rank")).otherwise(-1).alias("upto"))
    meant = ranked.join(best, ["file", "name"]).where("rank <= upto").select("file", "name", "namespace", F.col("visibility").alias("v"), F.col("b").alias("p")).distinct()
    at = (F.col("type") == F.col("name")) & (placed["namespace"] == meant["namespace"]) & F.col("v").eqNullSafe(F.col("visibility")) & F.col("p").eqNullSafe(F.col("b"))
    return found.unionByName(meant.join(placed, at).select("file", "name", "target", "type")).distinct()


def symbol_edges(found: DataFrame) -> DataFrame:
    """(source, target, names): edges between files, with the names of the types, in order."""
    return found.where("file <> target").groupBy(F.col("file").alias("source"), "target").agg(F.array_sort(F.collect_set("type")).alias("names"))
