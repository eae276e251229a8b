"""Queries of names and scopes: order lines as scopes of a supplier's file, nested four by four, with what they declare and use."""

from __future__ import annotations

from sondage.operators import scopes as op
from sondage.registry import query
from sondage.sources import projection as P

LEVEL = "(1 + l_linenumber % 4)"
WIDTH = f"CASE {LEVEL} WHEN 1 THEN 1024 WHEN 2 THEN 256 WHEN 3 THEN 64 ELSE 16 END"
SLOT = f"(l_orderkey * 7 + l_partkey) % (4096 / {WIDTH})"
KIND = "CASE scope % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'function' WHEN 3 THEN 'block' ELSE 'catch' END"
LINES = f"SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_returnflag, {LEVEL} AS level, CAST({WIDTH} AS BIGINT) AS width, CAST(floor((l_orderkey * 7 + l_partkey) % CAST(4096 / {WIDTH} AS BIGINT)) AS BIGINT) AS slot FROM lineitem"
SCOPES_SQL = f"""SELECT path, scope, {KIND} AS kind, begin_ AS begin, begin_ + width AS end_ FROM (SELECT DISTINCT 'f' || CAST(l_suppkey AS VARCHAR) AS path, level * 100000 + slot AS scope, slot * width AS begin_, width FROM ({LINES}))
UNION ALL SELECT DISTINCT 'f' || CAST(l_suppkey AS VARCHAR), 0, 'module', 0, 4096 FROM lineitem"""
DECLARED_SQL = f"""SELECT 'f' || CAST(l_suppkey AS VARCHAR) AS path, CASE WHEN l_orderkey % 29 = 0 THEN 0 ELSE level * 100000 + slot END AS scope, CASE WHEN l_partkey % 17 = 0 THEN '_' ELSE '' END || 'v' || CAST(l_orderkey % 23 AS VARCHAR) AS name,
CASE l_partkey % 5 WHEN 0 THEN 'const' WHEN 1 THEN 'let' WHEN 2 THEN 'var' WHEN 3 THEN 'parameter' ELSE 'function' END AS kind, l_orderkey % 4096 AS at, l_partkey % 11 = 0 AS exported, l_partkey % 17 = 0 AS private FROM ({LINES}) WHERE l_orderkey % 3 = 0"""
USED_SQL = f"""SELECT 'f' || CAST(l_suppkey AS VARCHAR) AS path, level * 100000 + slot AS scope, CASE WHEN l_partkey % 13 = 0 THEN '_' ELSE '' END || 'v' || CAST(l_partkey % 24 AS VARCHAR) AS name, l_partkey % 4096 AS at,
CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'call' END AS role, l_returnflag = 'R' AS type_position FROM ({LINES})"""
#: The same scopes for Spark: its tasks hold the distinct rows of what they read, so these are two numbers and not texts.
DEALT_SQL = f"""SELECT 'f' || CAST(l_suppkey AS VARCHAR) AS path, scope, {KIND} AS kind, scope % 100000 * width AS begin, scope % 100000 * width + width AS end_
FROM (SELECT l_suppkey, scope, CAST({WIDTH.replace(LEVEL, "CAST(floor(scope / 100000) AS INT)")} AS BIGINT) AS width FROM (SELECT DISTINCT l_suppkey, level * 100000 + slot AS scope FROM ({LINES})))
UNION ALL SELECT 'f' || CAST(l_suppkey AS VARCHAR), 0, 'module', 0, 4096 FROM (SELECT DISTINCT l_suppkey FROM lineitem)"""

WITH = f"""WITH s AS MATERIALIZED (SELECT path, scope, kind, begin AS b, end_ AS e FROM ({SCOPES_SQL})),
d AS MATERIALIZED (SELECT x.*, s.b, s.e FROM (SELECT path, scope, name, min(struct_pack(ord := at, kind := kind, exported := exported, private := private)) AS m FROM ({DECLARED_SQL.replace(' AS at', ' AS at')}) GROUP BY 1, 2, 3) x JOIN s USING (path, scope)),
u AS MATERIALIZED (SELECT u.*, s.b, s.e FROM ({USED_SQL}) u JOIN s USING (path, scope)),
r AS MATERIALIZED (SELECT u.path, u.scope, u.name, u.at, u.role, u.type_position, arg_min(d.scope, d.e - d.b) AS declared FROM u LEFT JOIN d ON d.path = u.path AND d.name = u.name AND d.b <= u.b AND u.e <= d.e GROUP BY ALL)""".replace("u.at", 'u."at"').replace("ord := at", 'ord := "at"').replace(" AS at", ' AS "at"')


def _tables(spark, sf):
    scopes, declared, used = (P.view(spark, sf, text) for text in (DEALT_SQL, DECLARED_SQL, USED_SQL))
    return scopes.withColumnRenamed("end_", "end"), declared, used


@query("names_resolved", f"{WITH} SELECT path, scope, name, \"at\", role, type_position, declared FROM r")
def _(spark, sf):
    scopes, declared, used = _tables(spark, sf)
    return op.resolve(scopes, declared, used.distinct())


@query("names_shadowed", f"""{WITH} SELECT a.path, a.name, a.scope AS inner, arg_min(o.scope, o.e - o.b) AS outer FROM d a JOIN d o ON o.path = a.path AND o.name = a.name AND o.b <= a.b AND a.e <= o.e AND o.scope <> a.scope GROUP BY 1, 2, 3""".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def _(spark, sf):
    scopes, declared, _ = _tables(spark, sf)
    return op.shadowed(scopes, declared)


@query("names_used_before_defined", f"""{WITH}, x AS (SELECT r.*, s.b AS ub, s.e AS ue, t.b AS db, t.e AS de FROM r JOIN s USING (path, scope) JOIN s t ON t.path = r.path AND t.scope = r.declared WHERE NOT type_position),
y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM s f WHERE f.path = x.path AND f.kind = 'function' AND f.b <= x.ub AND x.ue <= f.e AND f.b >= x.db AND f.e <= x.de AND f.scope <> x.declared))
SELECT d.path, d.scope, d.name, d.m.ord AS "at", min(y."at") AS used FROM d JOIN y ON y.path = d.path AND y.declared = d.scope AND y.name = d.name WHERE d.m.kind NOT IN ('var', 'function') GROUP BY 1, 2, 3, 4 HAVING min(y."at") < d.m.ord""")
def _(spark, sf):
    return op.used_before_defined(*_tables(spark, sf))


@query("names_unused", f"""{WITH} SELECT path, scope, name, d.m.kind AS kind, d.m.ord AS "at" FROM d WHERE NOT d.m.exported AND NOT (d.m.kind = 'parameter' AND starts_with(name, '_')) AND (path, scope, name) NOT IN (SELECT (path, declared, name) FROM r WHERE declared IS NOT NULL)""")
def _(spark, sf):
    return op.unused(*_tables(spark, sf))


@query("names_undeclared", f"""{WITH} SELECT DISTINCT path, name, "at" FROM r WHERE declared IS NULL AND name NOT IN (SELECT '_v' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)""")
def _(spark, sf):
    known = P.view(spark, sf, "SELECT '_v' || CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_regionkey = 1")
    return op.undeclared(*_tables(spark, sf), known)


@query("names_private_members", f"""{WITH} SELECT d.path, d.scope, d.name, coalesce(bool_or(role = 'write'), false) AS written, coalesce(bool_or(role = 'read'), false) AS read, coalesce(bool_or(role = 'call'), false) AS called FROM d JOIN s ON s.path = d.path AND s.scope = d.scope AND s.kind = 'class'
LEFT JOIN r ON r.path = d.path AND r.declared = d.scope AND r.name = d.name WHERE d.m.private GROUP BY 1, 2, 3""")
def _(spark, sf):
    return op.private_members(*_tables(spark, sf))
