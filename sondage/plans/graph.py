"""Queries over the module graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions.scalars import route_match, severity_rank
from sondage.operators import graph as op
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P

WITH = f"WITH m AS ({P.MODULES_SQL}), i AS ({P.IMPORTS_SQL})"
EDGES = """, e AS (SELECT i.source, i.target, a.service AS source_service, a.layer AS source_layer, b.service AS target_service, b.layer AS target_layer
FROM i JOIN m a ON i.source = a.module_id JOIN m b ON i.target = b.module_id)"""


def _edges(spark, sf):
    return op.module_edges(P.imports(spark, sf), P.modules(spark, sf))


@query("call_counts", f"WITH c AS ({P.CALLS_SQL}) SELECT caller, callee, count(*) AS call_count FROM c GROUP BY 1, 2")
def _(spark, sf):
    return op.call_counts(P.calls(spark, sf))


@query("module_edges", f"{WITH}{EDGES} SELECT * FROM e")
def _(spark, sf):
    return _edges(spark, sf)


@query("cross_service_imports", f"{WITH}{EDGES} SELECT * FROM e WHERE source_service <> target_service")
def _(spark, sf):
    return op.module_edges(P.imports(spark, sf), P.modules(spark, sf), drop_within=True)


@query("layer_violations", f"""{WITH}{EDGES} SELECT e.*, rule FROM e JOIN (VALUES ('data', 'api', 'data-layer-depends-on-api'), ('data', 'external', 'data-layer-depends-on-external'),
('external', 'api', 'external-layer-depends-on-api')) r(source_layer, target_layer, rule) USING (source_layer, target_layer)""")
def _(spark, sf):
    return op.layer_violations(_edges(spark, sf))


@query("entry_points", f"{WITH} SELECT module_id, name FROM m WHERE module_id NOT IN (SELECT target FROM i)")
def _(spark, sf):
    return op.without(P.modules(spark, sf), "module_id", P.imports(spark, sf), "target").select("module_id", "name")


@query("orphan_modules", f"{WITH} SELECT module_id, layer FROM m WHERE module_id NOT IN (SELECT target FROM i) AND module_id NOT IN (SELECT source FROM i) AND layer <> 'api'")
def _(spark, sf):
    m, i = P.modules(spark, sf).where("layer <> 'api'"), P.imports(spark, sf)
    return op.without(op.without(m, "module_id", i, "target"), "module_id", i, "source").select("module_id", "layer")


@query("dead_methods", f"WITH p AS ({P.METHODS_SQL}) SELECT method_id FROM p WHERE NOT exported AND method_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 30)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 30").select(F.col("l_partkey").alias("method_id"))
    return P.methods(spark, sf).where("not exported").join(used.distinct(), "method_id", "left_anti").select("method_id")


#: The names that an order's lines import from a supplier, and those that the order passes on.
NAMED = "SELECT l_orderkey AS source, l_suppkey AS target, l_linenumber AS name FROM lineitem"
PASSED = "SELECT l_orderkey AS source, l_linenumber AS name FROM lineitem WHERE l_returnflag = 'N'"


@query("imported_not_reexported", f"WITH n AS ({NAMED}), r AS ({PASSED}) SELECT DISTINCT target FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = n.source AND r.name = n.name)")
def _(spark, sf):
    return op.truly_imported(P.view(spark, sf, NAMED), P.view(spark, sf, PASSED))


@query("service_pairs", f"{WITH}{EDGES} SELECT source_service, target_service, count(*) AS imports, count(DISTINCT target) AS targets FROM e GROUP BY 1, 2")
def _(spark, sf):
    return op.service_pairs(_edges(spark, sf))


@query("shared_services", f"{WITH}{EDGES} SELECT target_service AS service, count(DISTINCT source_service) AS consumers FROM e WHERE source_service <> target_service GROUP BY 1 HAVING count(DISTINCT source_service) >= 3")
def _(spark, sf):
    return op.shared_services(_edges(spark, sf).where("source_service <> target_service"))


@query("layer_summary", f"{WITH} SELECT service, layer, count(*) AS files, max(method_count) AS most_methods, array_to_string(list_sort(list_distinct(list(method_count % 4))), ',') AS evidence FROM m GROUP BY 1, 2")
def _(spark, sf):
    evidence = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("method_count") % 4)), lambda x: x.cast("string")), ",")
    return P.modules(spark, sf).groupBy("service", "layer").agg(F.count("*").alias("files"), F.max("method_count").alias("most_methods"), evidence.alias("evidence"))


@query("god_modules", f"{WITH} SELECT module_id, method_count, file_count, method_count > 15 AS god_module, file_count > 120 AS god_service FROM m WHERE method_count > 15 OR file_count > 120")
def _(spark, sf):
    m = P.modules(spark, sf)
    many, large = F.col("method_count") > 15, F.col("file_count") > 120
    return m.where(many | large).select("module_id", "method_count", "file_count", many.alias("god_module"), large.alias("god_service"))


@query("threshold_findings", f"""WITH p AS ({P.METHODS_SQL}) SELECT method_id, 'long-method' AS rule, statements AS measure, 30 AS most FROM p WHERE statements > 30
UNION ALL SELECT method_id, 'too-many-parameters', params, 5 FROM p WHERE params > 5 UNION ALL SELECT method_id, 'deeply-nested-logic', nesting, 4 FROM p WHERE nesting > 4""")
def _(spark, sf):
    return op.threshold_findings(P.methods(spark, sf))


POINTS = "SELECT event_id AS point_id, user_id % 20 AS file, event_id % 1000 AS line FROM events"
RANGES = "SELECT p_partkey AS method_id, p_partkey % 20 AS file, (p_partkey * 37) % 1000 AS line_start, (p_partkey * 37) % 1000 + p_size AS line_end FROM part"


@query("enclosing_function", f"WITH p AS ({POINTS}), r AS ({RANGES}) SELECT point_id, arg_min(method_id, (line_end - line_start) * 100000000 + method_id) AS method_id FROM p JOIN r ON p.file = r.file AND line BETWEEN line_start AND line_end GROUP BY 1")
def _(spark, sf):
    return op.innermost(P.view(spark, sf, POINTS), P.view(spark, sf, RANGES))


@query("first_enclosing_function", f"WITH p AS ({POINTS}), r AS ({RANGES}) SELECT point_id, min(method_id) AS method_id FROM p JOIN r ON p.file = r.file AND line BETWEEN line_start AND line_end GROUP BY 1")
def _(spark, sf):
    return op.innermost(P.view(spark, sf, POINTS), P.view(spark, sf, RANGES), first=True)


@query("calls_to_methods", f"""WITH m AS ({P.MODULES_SQL}), p AS ({P.METHODS_SQL}), q AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS caller, l_partkey AS wanted FROM lineitem),
c AS (SELECT call_id, method_id, 0 AS strategy FROM q JOIN p ON wanted = method_id AND caller = module_id
UNION ALL SELECT call_id, method_id, 1 FROM q JOIN m a ON caller = a.module_id JOIN p ON wanted = method_id JOIN m b ON p.module_id = b.module_id AND a.service = b.service
UNION ALL SELECT call_id, method_id, 2 FROM q JOIN p ON wanted = method_id WHERE exported)
SELECT call_id, method_id, CAST(strategy AS INT) AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY strategy, method_id) AS k FROM c) WHERE k = 1""")
def _(spark, sf):
    q = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("wanted"))
    p, m = P.methods(spark, sf), P.modules(spark, sf)
    named = q.join(p, F.col("wanted") == F.col("method_id"))
    services = m.select("module_id", "service")
    near = named.join(services.select(F.col("module_id").alias("caller"), F.col("service").alias("s")), "caller").join(services, "module_id").where("s = service")
    found = [named.where("caller = module_id"), near, named.where("exported")]
    return op.best_candidate([x.select("call_id", "method_id") for x in found], ["call_id"], ["method_id"])


@query("reachable_modules", f"""WITH RECURSIVE m AS ({P.MODULES_SQL}), i AS ({P.IMPORTS_SQL}), r(start, node, depth) AS (SELECT module_id, module_id, 0 FROM m
UNION SELECT r.start, i.target, r.depth + 1 FROM r JOIN i ON r.node = i.source WHERE r.depth < 5) SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return op.reachable(P.imports(spark, sf), P.modules(spark, sf).select(F.col("module_id").alias("node")), 5)


CLOSURE = f"""WITH RECURSIVE i AS ({P.IMPORTS_SQL}), m AS ({P.MODULES_SQL}), r(a, b) AS (SELECT module_id, module_id FROM m UNION SELECT r.a, i.target FROM r JOIN i ON r.b = i.source),
c AS (SELECT x.a AS node, min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), z AS (SELECT label, count(*) AS size FROM c GROUP BY 1),
e AS (SELECT source, target, a.label, size FROM i JOIN c a ON a.node = source JOIN c b ON b.node = target JOIN z ON z.label = a.label WHERE a.label = b.label AND source <> target)"""
PATHS = """, w(path, first, last, label, n) AS (SELECT [source, target], source, target, label, 2 FROM e WHERE {start} UNION ALL
SELECT list_append(path, e.target), first, e.target, w.label, n + 1 FROM w JOIN e ON e.source = last WHERE n < {most} AND e.target > first AND NOT list_contains(path, e.target)),
d AS (SELECT path, n, w.label FROM w JOIN e ON e.source = last AND e.target = first)"""
SHOWN = lambda: F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")


@query("strong_components", f"{CLOSURE} SELECT node, label FROM c")
def _(spark, sf):
    nodes = P.modules(spark, sf).select(F.col("module_id").alias("node"))
    return op.components(P.imports(spark, sf), nodes, "node")


@query("short_cycles", CLOSURE + PATHS.format(start="size <= 5 AND source < target", most=5) + " SELECT array_to_string(path, ',') AS path, n FROM d")
def _(spark, sf):
    nodes = P.modules(spark, sf).select(F.col("module_id").alias("node"))
    return op.component_cycles(P.imports(spark, sf), op.components(P.imports(spark, sf), nodes, "node"), 5).select(SHOWN(), "n")


@query("shortest_cycles", CLOSURE + PATHS.format(start="size > 5 AND source < target", most=30) + """ SELECT label, array_to_string(path, ',') AS path, n
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n, path) AS k FROM d) WHERE k = 1""")
def _(spark, sf):
    nodes = P.modules(spark, sf).select(F.col("module_id").alias("node"))
    return op.shortest_cycles(P.imports(spark, sf), op.components(P.imports(spark, sf), nodes, "node"), 5).select("label", SHOWN(), "n")


@query("traced_flows")
def _(spark, sf):
    entries = op.without(P.modules(spark, sf).where("layer = 'api'"), "module_id", P.imports(spark, sf), "target").select(F.col("module_id").alias("node"))
    return op.traced_flows(P.imports(spark, sf), entries)


@query("flow_severity", f"""{WITH}, f AS ({P.FINDINGS_SQL}), s AS (SELECT m.module_id AS entry, m.module_id AS node FROM m UNION SELECT source, target FROM i), w AS (
SELECT user_id AS node, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS r FROM f GROUP BY 1)
SELECT entry, CAST(min(r) AS INT) AS worst FROM s LEFT JOIN w USING (node) GROUP BY 1""")
def _(spark, sf):
    steps = P.modules(spark, sf).select(F.col("module_id").alias("entry"), F.col("module_id").alias("node")).union(P.imports(spark, sf).select("source", "target")).distinct()
    found = P.findings(spark, sf).withColumn("node", F.col("user_id"))
    return op.flow_severity(steps, found, severity_rank(F.col("severity")))


@query("mounted_routes", """WITH mt AS (SELECT n_regionkey AS parent, 100 + n_nationkey AS child, '/' || lower(replace(n_name, ' ', '-')) AS path FROM nation
UNION ALL SELECT 100 + n_nationkey, 200 + n_nationkey % 4, '/v' || n_nationkey % 4 FROM nation WHERE n_nationkey < 8),
rt AS (SELECT 100 + n_nationkey AS router, '/items/{id}' AS route FROM nation UNION ALL SELECT 200 + n_nationkey % 4, '/deep' FROM nation WHERE n_nationkey < 4)
SELECT router, regexp_replace(prefix || route, '/+', '/', 'g') AS full_path FROM (
SELECT child AS router, path AS prefix FROM mt WHERE parent < 100 UNION ALL SELECT b.child, a.path || b.path FROM mt a JOIN mt b ON b.parent = a.child WHERE a.parent < 100) JOIN rt USING (router)""")
def _(spark, sf):
    mounts = P.view(spark, sf, """SELECT n_regionkey AS parent, 100 + n_nationkey AS child, '/' || lower(replace(n_name, ' ', '-')) AS path FROM nation
    UNION ALL SELECT 100 + n_nationkey, 200 + n_nationkey % 4, '/v' || n_nationkey % 4 FROM nation WHERE n_nationkey < 8""")
    routes = P.view(spark, sf, "SELECT 100 + n_nationkey AS router, '/items/{id}' AS route FROM nation UNION ALL SELECT 200 + n_nationkey % 4, '/deep' FROM nation WHERE n_nationkey < 4")
    return op.mounted_routes(mounts, routes)


@query("route_handlers", """WITH u AS (SELECT DISTINCT '/api/' || lower(event_type) || '/' || CAST(user_id % 9 AS VARCHAR) AS url FROM events),
h AS (SELECT * FROM (VALUES ('/api/click/:id', 1), ('/api/view/<id>', 2), ('/api/{any}/3', 3), ('/api/error', 4), ('/api/click/3', 5)) t(route, handler)),
x AS (SELECT url, handler, url = route AS exact FROM u JOIN h ON regexp_matches(url, '^' || regexp_replace(regexp_replace(regexp_replace(route, ':[^/]+', '[^/]+', 'g'), '<[^/]+>', '[^/]+', 'g'), '\\{[^/]+\\}', '[^/]+', 'g') || '$'))
SELECT url, CAST(handler AS INT) AS handler FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY exact DESC, handler) AS k FROM x) WHERE k = 1""")
def _(spark, sf):
    urls = table(spark, sf, "events").select(F.concat(F.lit("/api/"), F.lower("event_type"), F.lit("/"), (F.col("user_id") % 9).cast("string")).alias("url")).distinct()
    known = spark.createDataFrame([("/api/click/:id", 1), ("/api/view/<id>", 2), ("/api/{any}/3", 3), ("/api/error", 4), ("/api/click/3", 5)], "route string, handler int")
    # routes are a service's own, not the corpus's: their number of segments makes the join an equi join
    n = lambda c: F.size(F.split(c, "/"))
    hit = urls.withColumn("n", n("url")).join(known.withColumn("n", n("route")), "n").where(route_match(F.col("url"), F.col("route")))
    return op.best_candidate([hit.where("url = route").select("url", "handler"), hit.where("url <> route").select("url", "handler")], ["url"], ["handler"]).drop("strategy")
