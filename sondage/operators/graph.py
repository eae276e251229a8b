"""Graph operators over edge tables: edges, anti joins, components, cycles, flows and ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Layers that others may not reach into, as (from, to, rule).
FORBIDDEN_LAYERS = (
    ("data", "api", "data-layer-depends-on-api"),
    ("data", "external", "data-layer-depends-on-external"),
    ("external", "api", "external-layer-depends-on-api"),
)

#: Times that edges which can lie on no cycle are dropped before a round.
TRIMS = 2


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only where none is named, on one machine."""
    sc = spark.sparkContext
    named, now = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if named:
        return named.rstrip("/")
    if now.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="sondage-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        return f"file:{own}"
    return now.get()


def kept(df: DataFrame) -> DataFrame:
    """Computed once, in the session's checkpoint folder.

    What the optimizer knew of the rows' origin is dropped: carried from round
    to round it would double with each join.
    """
    spark = df.sparkSession
    shared_folder(spark)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("call_count"))


def module_edges(edges: DataFrame, modules: DataFrame, drop_within: bool = False) -> DataFrame:
    """Edges with the service and layer of both ends; an end that isn't a module drops out."""
    s = modules.select(F.col("module_id").alias("source"), F.col("service").alias("source_service"), F.col("layer").alias("source_layer"))
    t = modules.select(F.col("module_id").alias("target"), F.col("service").alias("target_service"), F.col("layer").alias("target_layer"))
    out = edges.join(s, "source").join(t, "target")
    return out.where("source_service <> target_service") if drop_within else out


def layer_violations(edges: DataFrame) -> DataFrame:
    rules = edges.sparkSession.createDataFrame(FORBIDDEN_LAYERS, "source_layer string, target_layer string, rule string")
    return edges.join(F.broadcast(rules), ["source_layer", "target_layer"])  # three rows


def without(nodes: DataFrame, key: str, edges: DataFrame, end: str) -> DataFrame:
    """Nodes that are at no edge's ``end``: entry points, dead or orphan modules."""
    return nodes.join(edges.select(F.col(end).alias(key)).distinct(), key, "left_anti")


def service_pairs(edges: DataFrame) -> DataFrame:
    """Imports between services: their number and distinct targets."""
    return edges.groupBy("source_service", "target_service").agg(F.count("*").alias("imports"), F.countDistinct("target").alias("targets"))


def shared_services(edges: DataFrame, least: int = 3) -> DataFrame:
    """Services that at least ``least`` other services import."""
    return edges.groupBy(F.col("target_service").alias("service")).agg(F.countDistinct("source_service").alias("consumers")).where(F.col("consumers") >= least)


def threshold_findings(methods: DataFrame) -> DataFrame:
    """Methods that are too long, take too many parameters or nest too deeply."""
    checks = [("long-method", "statements", 30), ("too-many-parameters", "params", 5), ("deeply-nested-logic", "nesting", 4)]
    found = F.array(*[F.when(F.col(c) > most, F.struct(F.lit(rule).alias("rule"), F.col(c).cast("int").alias("measure"), F.lit(most).alias("most"))) for rule, c, most in checks])
    return methods.select("method_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("method_id", "x.*")


def innermost(points: DataFrame, ranges: DataFrame, first: bool = False) -> DataFrame:
    """For each point (file, line) the function range that holds it: the smallest, or the first listed.

    A range is the sum of at most two blocks for each power of two up to its
    length, a block being 2^k lines from a multiple of 2^k; of the ranges that
    hold a block whole, one is kept. A line then meets a row for each power of
    two at most, however many ranges hold it. Lines are whole numbers.
    """
    order = F.struct("method_id") if first else F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "method_id")
    rows = ranges.where("line_start <= line_end").select("file", F.col("line_start").cast("long").alias("b"), (F.col("line_end").cast("long") + 1).alias("e"), order.alias("found"))
    rows = rows.groupBy("file", "b", "e").agg(F.min("found").alias("found"))
    # at level k the range goes from the first whole block to the last; an odd first one and an even last one have no neighbour a level up
    level = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.expr("e - b"))) - 1)))
    ends = level.select("file", "level", "found", F.expr("-shiftright(-b, level)").alias("low"), F.expr("shiftright(e, level)").alias("high")).where("low < high")
    odd = lambda c: F.col(c).bitwiseAND(1) == 1
    own = F.filter(F.array(F.when(odd("low"), F.col("low")), F.when(odd("high"), F.col("high") - 1)), lambda x: x.isNotNull())
    blocks = ends.select("file", "level", F.explode(own).alias("block"), "found").groupBy("file", "level", "block").agg(F.min("found").alias("found"))
    lines = points.select("file", F.col("line").cast("long").alias("line")).where("line is not null").distinct()
    levels = F.broadcast(blocks.select("level").distinct())  # 64 rows at most
    held = lines.crossJoin(levels).withColumn("block", F.expr("shiftright(line, level)")).join(blocks, ["file", "level", "block"])
    best = held.groupBy("file", "line").agg(F.min("found").alias("found"))
    return points.withColumn("line", F.col("line").cast("long")).join(best, ["file", "line"]).groupBy("point_id").agg(F.min("found").alias("found")).select("point_id", "found.method_id")


def best_candidate(candidates: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Of candidate matches by several strategies, in order, the first of each key."""
    tagged = [c.withColumn("strategy", F.lit(k)) for k, c in enumerate(candidates)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    w = W.partitionBy(*keys).orderBy("strategy", *order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): the nodes within ``depth`` steps and the least number of steps, frontier by frontier."""
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        frontier = kept(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(node, label): strongly connected components, labelled by their least node.

    In a round every open node gets a priority by hash, and takes the first
    node by it that reaches it, and the first that it reaches. Where both are
    the same, it is of that node's component, which is closed. Edges between
    nodes that differ in either lie in no component and go; so a path without
    cycles falls into several shorter ones each round, and its ends, which no
    edge enters or leaves, are components of their own. Edges to no node of
    ``nodes`` don't count. An empty table gives an empty result.
    """
    every = kept(nodes.select(F.col(key).alias("node")).distinct())
    own = lambda end: every.select(F.col("node").alias(end))
    live = kept(edges.where("source <> target").select("source", "target").distinct().join(own("source"), "source", "left_semi").join(own("target"), "target", "left_semi"))
    found, number = [], 0
    while True:
        for _ in range(TRIMS):  # edges from a node that none enters, or to one that none leaves, lie on no cycle
            inner = live.join(live.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            live = inner.join(live.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
        live = kept(live)
        if live.isEmpty():
            break
        both = _first_reaching(live, number)
        found.append(both.where("up = down").select("node", F.col("up").alias("root")))
        at = lambda end, k: both.where("up <> down").select(F.col("node").alias(end), F.col("up").alias(f"u{k}"), F.col("down").alias(f"d{k}"))
        live = live.join(at("source", 1), "source").join(at("target", 2), "target").where("u1 = u2 and d1 = d2").select("source", "target")
        number += 1
    if not found:
        return every.select("node", F.col("node").alias("label"))
    closed = found[0]
    for f in found[1:]:
        closed = closed.unionByName(f)
    least = closed.groupBy("root").agg(F.min("node").alias("label"))
    labels = closed.join(least, "root").select("node", "label")
    return every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _first_reaching(edges: DataFrame, number: int) -> DataFrame:
    """(node, up, down): of the nodes that reach each node, and that it reaches, itself included, the first by a hash.

    What reaches a node's root reaches the node, so roots travel twice as far
    each round and a path of n nodes takes about log n rounds. Both directions
    go through the same rounds, as edges of two kinds.
    """
    both = kept(edges.select(F.lit(0).alias("way"), "source", "target").unionByName(edges.select(F.lit(1).alias("way"), F.col("target").alias("source"), F.col("source").alias("target"))))
    nodes = both.select("way", F.explode(F.array("source", "target")).alias("node")).distinct()
    now = kept(nodes.select("way", "node", F.struct(F.xxhash64("node", F.lit(number)).alias("h"), F.col("node").alias("root")).alias("r")))
    while True:
        came = both.join(now.select("way", F.col("node").alias("source"), F.col("r").alias("c")), ["way", "source"]).groupBy("way", F.col("target").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(came, ["way", "node"], "left").select("way", "node", F.col("r.root").alias("old"), F.least("r", F.coalesce("c", "r")).alias("near"))
        far = now.select("way", F.col("node").alias("at"), F.col("r").alias("far"))
        new = kept(step.withColumn("at", F.col("near.root")).join(far, ["way", "at"]).select("way", "node", "old", F.least("near", "far").alias("r")))
        now = new.select("way", "node", "r")
        if new.where("r.root <> old").isEmpty():
            up, down = (now.where(F.col("way") == k).select("node", F.col("r.root").alias(name)) for k, name in ((0, "up"), (1, "down")))
            return kept(up.join(down, "node"))


def _within(edges: DataFrame, labels: DataFrame, sizes) -> DataFrame:
    """(source, target, label): edges inside components whose size ``sizes`` accepts."""
    fit = labels.groupBy("label").agg(F.count("*").alias("size")).where(sizes(F.col("size"))).select("label")
    own = labels.join(fit, "label")
    joined = edges.where("source <> target").select("source", "target").distinct().join(own.select(F.col("node").alias("source"), "label"), "source")
    return joined.join(own.select(F.col("node").alias("target"), F.col("label").alias("other")), "target").where("label = other").select("source", "target", "label")


def component_cycles(edges: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """All simple cycles of the components of up to ``most`` nodes: of five nodes there are 84 at the most."""
    return short_cycles(kept(_within(edges, labels, lambda n: (n > 1) & (n <= most))), most)


def shortest_cycles(edges: DataFrame, labels: DataFrame, beyond: int = 5) -> DataFrame:
    """(label, path, n): of each component of more than ``beyond`` nodes its shortest cycle, from its least node.

    Of several the least path counts. Paths grow from every node by a step a
    round, one path, the least, for each pair of ends; a component is done with
    the first round that closes any, so a pair never has a second path.
    """
    e = kept(_within(edges, labels, lambda n: n > beyond))
    paths = seen = kept(e.where("target > source").select("label", F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path")))
    out, n = None, 2
    while not paths.isEmpty():
        closing = e.select(F.col("source").alias("last"), F.col("target").alias("first"))
        done = kept(paths.join(closing, ["last", "first"], "left_semi").groupBy("label").agg(F.min("path").alias("path")).withColumn("n", F.lit(n)))
        out = done if out is None else out.unionByName(done)
        going = paths.join(done.select("label"), "label", "left_anti")
        step = going.join(e.select(F.col("source").alias("last"), "target"), "last").where(F.col("target") > F.col("first"))
        new = step.select("label", "first", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path")).groupBy("label", "first", "last").agg(F.min("path").alias("path"))
        paths = kept(new.join(seen.select("first", "last"), ["first", "last"], "left_anti"))
        seen, n = kept(seen.select("first", "last").unionByName(paths.select("first", "last"))), n + 1
    return out if out is not None else paths.select("label", "path", F.lit(0).alias("n")).limit(0)


def truly_imported(imports: DataFrame, passed_on: DataFrame) -> DataFrame:
    """Targets of which some importer takes a name that it doesn't merely pass on."""
    return imports.join(passed_on.select("source", "name").distinct(), ["source", "name"], "left_anti").select("target").distinct()


def short_cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """Simple cycles of two to ``most`` nodes, each once, from its least node."""
    e = edges.where("source <> target").select("source", "target").distinct()
    paths, out = e.where("target > source").select(F.col("source").alias("first"), F.array("source", "target").alias("path")), None
    for n in range(2, most + 1):
        closing = e.select(F.col("source").alias("last"), F.col("target").alias("first"))
        done = paths.withColumn("last", F.element_at("path", -1)).join(closing, ["last", "first"], "left_semi").select("path", F.lit(n).alias("n"))
        out = done if out is None else out.unionByName(done)
        if n < most:
            step = paths.withColumn("last", F.element_at("path", -1)).join(e, F.col("last") == F.col("source"))
            paths = step.where((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target"))).select("first", F.concat("path", F.array("target")).alias("path"))
    return out


def mounted_routes(mounts: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes with the prefixes of all routers above, once per way from a root router, however long.

    A way meets each router once, so cycles end. A route whose router is
    mounted nowhere, or has no way from a root, keeps its own path.
    """
    mounted = mounts.select("child").distinct()
    top = mounts.select(F.col("parent").alias("router")).distinct().join(mounted.withColumnRenamed("child", "router"), "router", "left_anti")
    every = level = kept(top.select("router", F.lit("").alias("prefix"), F.array("router").alias("way")))
    while not level.isEmpty():
        step = level.join(mounts, level["router"] == mounts["parent"]).where(~F.array_contains("way", F.col("child")))
        level = kept(step.select(F.col("child").alias("router"), F.concat("prefix", "path").alias("prefix"), F.concat("way", F.array("child")).alias("way")))
        every = kept(every.unionByName(level))
    found = routes.join(every.select("router", "prefix"), "router", "left")
    return found.select("router", F.regexp_replace(F.concat(F.coalesce("prefix", F.lit("")), "route"), "/+", "/").alias("full_path"))


def traced_flows(calls: DataFrame, entries: DataFrame, depth: int = 20) -> DataFrame:
    """(entry, step, node, depth): each entry's calls in depth-first order, neighbours by id, each node once.

    A depth-first order can't be had from set operations, so each entry's
    reachable subgraph (its edges only) is walked in one group.
    """
    reach = reachable(calls, entries, depth).select("start", F.col("node").alias("source"))
    sub = reach.join(calls.select("source", "target").distinct(), "source", "left").select("start", "source", "target")

    def walk(pdf):
        import pandas as pd

        start, edges = pdf["start"].iloc[0], {}
        for a, b in sorted(zip(pdf["source"], pdf["target"], strict=True), key=lambda x: (x[0], x[1] != x[1], x[1])):
            if b == b:
                edges.setdefault(int(a), []).append(int(b))
        seen, out, stack = set(), [], [(int(start), 0)]
        while stack:
            node, d = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((int(start), len(out), node, d))
            if d < depth:
                stack += [(x, d + 1) for x in reversed(edges.get(node, [])) if x not in seen]
        return pd.DataFrame(out, columns=["entry", "step", "node", "depth"])

    return sub.groupBy("start").applyInPandas(walk, "entry long, step int, node long, depth int")


def flow_severity(steps: DataFrame, findings: DataFrame, rank: Column) -> DataFrame:
    """The worst severity, as a rank, among the findings of a flow's nodes; null without findings."""
    worst = findings.groupBy("node").agg(F.min(rank).alias("r"))
    return steps.join(worst, "node", "left").groupBy("entry").agg(F.min("r").alias("worst"))
