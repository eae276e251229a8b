"""Queries of the graph view: suppliers as modules, parts as methods, order lines as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import views
from sondage.registry import query
from sondage.sources import projection as P

#: Modules of which some share a file, and some are on no edge.
MODULES_SQL = f"SELECT module_id, service, layer, service || '/f' || CAST(module_id % 37 AS VARCHAR) || '.ts' AS file_path FROM ({P.MODULES_SQL})"
MODULE_DEPS_SQL = f"SELECT source, target, 1 + (source + target) % 3 AS n FROM ({P.IMPORTS_SQL}) WHERE source % 5 <> 1 AND target % 5 <> 1"
METHODS_SQL = "SELECT p_partkey AS method_id, p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS module_id FROM part"
METHOD_DEPS_SQL = "SELECT l_partkey AS source, (l_partkey * 3 + l_suppkey) % (SELECT max(p_partkey) FROM part) + 1 AS target, count(*) AS n FROM lineitem WHERE l_partkey % 4 = 0 AND l_suppkey % 3 = 0 GROUP BY 1, 2"
HTTP_SQL = "SELECT 'svc' || CAST(n_nationkey % 5 AS VARCHAR) AS source, 'svc' || CAST((n_regionkey + n_nationkey) % 5 AS VARCHAR) AS target, count(*) AS n FROM nation WHERE n_regionkey % 5 <> 0 GROUP BY 1, 2"
VIOLATIONS_SQL = f"SELECT CASE WHEN source % 2 = 0 THEN source ELSE target END AS source, CASE WHEN source % 2 = 0 THEN target ELSE source END AS target, 'reason ' || CAST(source % 4 AS VARCHAR) AS title FROM ({P.IMPORTS_SQL}) WHERE (source + target) % 7 = 0"
DB_SQL = "SELECT DISTINCT 'svc' || CAST(n_nationkey % 5 AS VARCHAR) AS service FROM nation WHERE n_nationkey % 5 IN (0, 3)"
FOUND_SQL = "SELECT user_id % (SELECT max(s_suppkey) FROM supplier) + 1 AS module_id, CASE WHEN event_id % 3 > 0 THEN user_id * 7 % (SELECT max(p_partkey) FROM part) + 1 END AS method_id, event_id % 5 AS rank FROM events WHERE user_id % 4 > 0"
_WITH = f"""WITH m AS ({MODULES_SQL}), d AS ({MODULE_DEPS_SQL}), h AS ({HTTP_SQL}), t AS ({METHODS_SQL}), e AS ({METHOD_DEPS_SQL}), x AS ({VIOLATIONS_SQL}),
md AS (SELECT d.*, a.service AS ss, b.service AS ts FROM d JOIN m a ON a.module_id = source JOIN m b ON b.module_id = target)"""


def _http(level: str, present: str) -> str:
    return f"""SELECT '{level}', 'module', CAST(s AS VARCHAR), CAST(t AS VARCHAR), n, 'http' FROM (SELECT (SELECT arg_min(module_id, (layer NOT IN ('external', 'service'), module_id)) FROM m WHERE service = h.source) AS s,
(SELECT arg_min(module_id, (layer <> 'api', module_id)) FROM m WHERE service = h.target) AS t, n FROM h) WHERE s IS NOT NULL AND t IS NOT NULL AND (s, t) NOT IN (SELECT (source, target) FROM {present})"""


@query("graph_view", f"""{_WITH}, em AS (SELECT e.*, a.module_id AS sm, b.module_id AS tm FROM e JOIN t a ON a.method_id = source JOIN t b ON b.method_id = target), st AS (SELECT * FROM md WHERE (source, target) NOT IN (SELECT (sm, tm) FROM em WHERE sm <> tm)),
g(level, source_kind, source, target, n, kind) AS (SELECT 'service', 'service', ss, ts, sum(n)::BIGINT, 'module-dep' FROM md WHERE ss <> ts GROUP BY ss, ts UNION ALL SELECT 'service', 'service', source, target, n, 'http' FROM h
UNION ALL SELECT 'module', 'module', CAST(source AS VARCHAR), CAST(target AS VARCHAR), n, 'module-dep' FROM md UNION ALL {_http('module', 'md')}
UNION ALL SELECT 'method', 'method', CAST(source AS VARCHAR), CAST(target AS VARCHAR), n, 'method-dep' FROM em UNION ALL SELECT 'method', 'module', CAST(source AS VARCHAR), CAST(target AS VARCHAR), n, 'module-dep' FROM st UNION ALL {_http('method', 'st')}),
v AS (SELECT s, t, min(title) AS reason FROM (SELECT CAST(source AS VARCHAR) AS s, CAST(target AS VARCHAR) AS t, title FROM x UNION ALL SELECT CAST(target AS VARCHAR), CAST(source AS VARCHAR), title FROM x) GROUP BY 1, 2)
SELECT g.*, reason FROM g LEFT JOIN v ON g.source_kind = 'module' AND s = g.source AND t = g.target""")
def _(spark, sf):
    return views.graph_edges(*(P.view(spark, sf, text) for text in (MODULES_SQL, MODULE_DEPS_SQL, METHODS_SQL, METHOD_DEPS_SQL, HTTP_SQL, VIOLATIONS_SQL)))


@query("graph_nodes", f"""{_WITH}, b AS ({DB_SQL}), f AS (SELECT f.*, service, service || '__' || layer AS lay FROM ({FOUND_SQL}) f JOIN m USING (module_id)),
dead AS (SELECT module_id FROM m WHERE module_id NOT IN (SELECT source FROM d UNION SELECT target FROM d) AND file_path IN (SELECT file_path FROM m JOIN d ON target = module_id) AND NOT (layer = 'data' AND service IN (SELECT service FROM b))),
z(kind, id, parent, dead) AS (SELECT DISTINCT 'service', service, NULL, false FROM m UNION ALL SELECT DISTINCT 'layer', service || '__' || layer, service, false FROM m UNION ALL SELECT 'module', CAST(module_id AS VARCHAR), service || '__' || layer, module_id IN (SELECT module_id FROM dead) FROM m
UNION ALL SELECT 'method', CAST(method_id AS VARCHAR), CAST(module_id AS VARCHAR), method_id NOT IN (SELECT source FROM e UNION SELECT target FROM e) FROM t WHERE module_id IN (SELECT module_id FROM m)),
w(kind, id, n, worst) AS (SELECT 'service', service, count(*), min(rank) FROM f GROUP BY 2 UNION ALL SELECT 'layer', lay, count(*), min(rank) FROM f GROUP BY 2 UNION ALL SELECT 'module', CAST(module_id AS VARCHAR), count(*), min(rank) FROM f GROUP BY 2 UNION ALL SELECT 'method', CAST(method_id AS VARCHAR), count(*), min(rank) FROM f WHERE method_id IS NOT NULL GROUP BY 2)
SELECT z.*, coalesce(n, 0) AS n, CAST(worst AS INT) AS worst FROM z LEFT JOIN w USING (kind, id)""")
def _(spark, sf):
    tables = (P.view(spark, sf, text) for text in (MODULES_SQL, MODULE_DEPS_SQL, METHODS_SQL, METHOD_DEPS_SQL, DB_SQL, FOUND_SQL))
    return views.graph_nodes(*tables, F.col("rank"))
