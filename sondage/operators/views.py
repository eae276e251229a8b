"""The graph of a run as it is shown: nodes and edges at the levels of services, modules and methods.

Edges are lifted to every level at once by grouping sets over the ancestors of
both ends. Where a level lacks a direct edge, one of the level above stands in:
module edges among methods, and calls between services among modules, from the
module that speaks for the one service to the one that answers for the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Layers whose modules call other services, and the one that answers them.
CALLING, ANSWERING = ("external", "service"), "api"


def _ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``edges`` with ``columns`` of both ends, as source_… and target_…; an edge with an end that isn't there drops out."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def lifted(module_deps: DataFrame, modules: DataFrame) -> DataFrame:
    """(level, source, target, n): module edges, and their sums between services, in one aggregation; ends as texts.

    module_deps: source, target, n; modules: module_id, service. Edges within a service aren't lifted.
    """
    placed = _ends(module_deps, modules.withColumnRenamed("module_id", "id"), "service").withColumns({"s": F.col("source").cast("string"), "t": F.col("target").cast("string")})
    of_module = F.grouping("s") == 0
    sums = placed.groupingSets([["s", "t"], ["source_service", "target_service"]], "s", "t", "source_service", "target_service").agg(F.sum("n").alias("n"), of_module.alias("m"))
    named = sums.select(F.when(F.col("m"), "module").otherwise("service").alias("level"), F.coalesce("s", "source_service").alias("source"), F.coalesce("t", "target_service").alias("target"), "n")
    return named.where("level = 'module' or source <> target")


def http_edges(http: DataFrame, modules: DataFrame, present: DataFrame) -> DataFrame:
    """(source, target, n): calls between services as edges of modules, where ``present`` (source, target) has none.

    http: source, target (services), n. A service calls by its first module in
    a calling layer and answers by its first in the answering one; else by its
    first module. Of several calls between two modules the least services' counts.
    """
    first = lambda fits: F.min_by("module_id", F.struct((~fits).alias("other"), "module_id"))
    speakers = modules.groupBy("service").agg(first(F.col("layer").isin(*CALLING)).cast("string").alias("calls"), first(F.col("layer") == ANSWERING).cast("string").alias("answers"))
    a = speakers.select(F.col("service").alias("source"), F.col("calls").alias("s"))
    b = speakers.select(F.col("service").alias("target"), F.col("answers").alias("t"))
    pairs = http.join(a, "source").join(b, "target").groupBy("s", "t").agg(F.min_by("n", F.struct("source", "target")).alias("n"))
    return pairs.select(F.col("s").alias("source"), F.col("t").alias("target"), "n").join(present.select("source", "target").distinct(), ["source", "target"], "left_anti")


def graph_edges(modules: DataFrame, module_deps: DataFrame, methods: DataFrame, method_deps: DataFrame, http: DataFrame, violations: DataFrame) -> DataFrame:
    """(level, source_kind, source, target, n, kind, reason): all edges of the three levels; both ends are of one kind.

    modules: module_id, service, layer; module_deps and method_deps: source,
    target, n, each pair once; methods: method_id, module_id; violations:
    source, target (modules), title. Among methods a module edge stands where no
    edge of their methods does. An edge of modules that a violation names, in
    either direction, has its title as ``reason`` (the least, of several). Ids
    are texts in the result; edges with an end that isn't there drop out; empty
    tables give no edges.
    """
    up = lifted(module_deps, modules)
    of_modules, of_services = up.where("level = 'module'").drop("level"), up.where("level = 'service'").drop("level")
    own = _ends(method_deps, methods.select(F.col("method_id").alias("id"), F.col("module_id").cast("string").alias("module")), "module")
    covered = own.where("source_module <> target_module").select(F.col("source_module").alias("source"), F.col("target_module").alias("target")).distinct()
    stand_in = of_modules.join(covered, ["source", "target"], "left_anti")

    def part(rows: DataFrame, level: str, ends: str, kind: str) -> DataFrame:
        return rows.select(F.lit(level).alias("level"), F.lit(ends).alias("source_kind"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("n").cast("long").alias("n"), F.lit(kind).alias("kind"))

    every = (
        part(of_services, "service", "service", "module-dep").unionByName(part(http, "service", "service", "http"))
        .unionByName(part(of_modules, "module", "module", "module-dep")).unionByName(part(http_edges(http, modules, of_modules), "module", "module", "http"))
        .unionByName(part(own, "method", "method", "method-dep")).unionByName(part(stand_in, "method", "module", "module-dep")).unionByName(part(http_edges(http, modules, stand_in), "method", "module", "http"))
    )
    both = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).alias("x")
    named = violations.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "title").select(both, "title").groupBy("x.source", "x.target").agg(F.min("title").alias("reason"))
    return every.join(named.withColumn("source_kind", F.lit("module")), ["source_kind", "source", "target"], "left").select(*every.columns, "reason")


def dead_modules(modules: DataFrame, module_deps: DataFrame, db_services: DataFrame) -> DataFrame:
    """(module_id): modules on no edge whose file others import, unless they are data modules of a service with a database."""
    ends = module_deps.select(F.col("source").alias("module_id")).unionByName(module_deps.select(F.col("target").alias("module_id"))).distinct()
    imported = modules.join(module_deps.select(F.col("target").alias("module_id")).distinct(), "module_id", "left_semi").select("file_path").distinct()
    loose = modules.join(ends, "module_id", "left_anti").join(imported, "file_path", "left_semi")
    kept = loose.where("layer = 'data'").join(db_services.select("service").distinct(), "service", "left_semi").select("module_id")
    return loose.select("module_id").join(kept, "module_id", "left_anti")


def graph_nodes(modules: DataFrame, module_deps: DataFrame, methods: DataFrame, method_deps: DataFrame, db_services: DataFrame, findings: DataFrame, rank: Column) -> DataFrame:
    """(kind, id, parent, dead, n, worst): services, their layers, modules and methods, with what was found in and below each.

    findings: module_id, method_id (null where a finding is the module's);
    ``rank``: of a finding, 0 for the worst. Findings are rolled up by one
    aggregation over grouping sets. A layer's id is its service's and its name;
    methods on no edge are dead; services and layers never are.
    """
    layer = F.concat_ws("__", "service", "layer")
    of_module = modules.select("module_id", "service", layer.alias("layer_id"), "file_path", "layer")
    found = findings.select("module_id", "method_id", rank.alias("rank")).join(of_module, "module_id").select("service", "layer_id", F.col("module_id").cast("string").alias("module"), F.col("method_id").cast("string").alias("method"), "rank")
    keys = ["service", "layer_id", "module", "method"]
    names = ["service", "layer", "module", "method"]
    sums = found.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.min("rank").alias("worst"), F.grouping_id().alias("g"))
    kind = F.lit(None).cast("string")
    for k, name in enumerate(names):
        kind = F.when(F.col("g") == (15 ^ (8 >> k)), name).otherwise(kind)
    rolled = sums.select(kind.alias("kind"), F.coalesce(*keys).alias("id"), "n", "worst").where("id is not null")
    dead = dead_modules(modules, module_deps, db_services).withColumn("dead", F.lit(True))
    ends = method_deps.select(F.col("source").alias("method_id")).unionByName(method_deps.select(F.col("target").alias("method_id"))).distinct().withColumn("live", F.lit(True))
    no = F.lit(False)
    nodes = (
        of_module.select(F.lit("service").alias("kind"), F.col("service").alias("id"), F.lit(None).cast("string").alias("parent"), no.alias("dead")).distinct()
        .unionByName(of_module.select(F.lit("layer").alias("kind"), F.col("layer_id").alias("id"), F.col("service").alias("parent"), no.alias("dead")).distinct())
        .unionByName(of_module.join(dead, "module_id", "left").select(F.lit("module").alias("kind"), F.col("module_id").cast("string").alias("id"), F.col("layer_id").alias("parent"), F.coalesce("dead", no).alias("dead")))
        .unionByName(methods.join(modules.select("module_id"), "module_id", "left_semi").join(ends, "method_id", "left").select(F.lit("method").alias("kind"), F.col("method_id").cast("string").alias("id"), F.col("module_id").cast("string").alias("parent"), F.col("live").isNull().alias("dead")))
    )
    return nodes.join(rolled, ["kind", "id"], "left").select("kind", "id", "parent", "dead", F.coalesce("n", F.lit(0)).alias("n"), F.col("worst").cast("int").alias("worst"))
