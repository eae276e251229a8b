"""Queries of edges by named types: parts declare types, order lines name them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import symbols
from sondage.registry import query
from sondage.sources import projection as P

SPACE = "p_type || CASE WHEN p_size % 4 = 0 THEN '' ELSE '.B' || CAST(p_size % 3 AS VARCHAR) END"
FILES_SQL = "SELECT DISTINCT 'c' || CAST(p_partkey % 400 AS VARCHAR) AS file, CASE WHEN p_partkey % 400 % 9 = 0 THEN NULL ELSE 'p' || CAST(p_partkey % 400 % 7 AS VARCHAR) END AS project FROM part"
TYPES_SQL = f"SELECT 'T' || CAST(p_partkey % 90 AS VARCHAR) AS name, {SPACE} AS namespace, 'c' || CAST(p_partkey % 400 AS VARCHAR) AS file, CASE WHEN p_partkey % 5 = 0 THEN 'internal' ELSE 'public' END AS visibility FROM part"
DECLARED_SQL = f"SELECT DISTINCT 'c' || CAST(p_partkey % 400 AS VARCHAR) AS file, {SPACE} AS namespace FROM part WHERE p_partkey % 3 = 0"
USINGS_SQL = f"""SELECT 'c' || CAST(p_partkey * 3 % 400 AS VARCHAR) AS file, {SPACE} AS target, NULL AS alias, false AS is_static, p_partkey % 50 = 1 AS is_global FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT DISTINCT 'c' || CAST(p_partkey * 7 % 400 AS VARCHAR), p_type, 'A', false, false FROM part WHERE p_partkey % 11 = 0 AND p_type = 'PROMO'
UNION ALL SELECT 'c' || CAST(p_partkey % 400 AS VARCHAR), p_type || '.B1.T' || CAST(p_size AS VARCHAR), NULL, true, false FROM part WHERE p_partkey % 13 = 0"""
REFS_SQL = """SELECT DISTINCT 'c' || CAST(l_orderkey % 400 AS VARCHAR) AS file, CASE l_linenumber % 4 WHEN 0 THEN 'ECONOMY.B2.T' || CAST(l_partkey % 90 AS VARCHAR) || '.Inner' WHEN 1 THEN 'A.T' || CAST(l_partkey % 90 AS VARCHAR) ELSE 'T' || CAST(l_partkey % 90 AS VARCHAR) END AS name FROM lineitem WHERE l_quantity > 30"""
PROJECTS_SQL = "SELECT DISTINCT 'p' || CAST(n_nationkey % 7 AS VARCHAR) AS project, 'p' || CAST((n_nationkey + 1 + n_regionkey % 2) % 7 AS VARCHAR) AS referenced FROM nation"
RESOLVED = f"""f AS ({FILES_SQL}), t AS (SELECT DISTINCT *, namespace || '.' || name AS full_ FROM ({TYPES_SQL})), d AS ({DECLARED_SQL}), u AS ({USINGS_SQL}), j AS ({PROJECTS_SQL}),
v AS (SELECT file, namespace FROM d UNION SELECT file, split_part(namespace, '.', 1) FROM d UNION SELECT file, '' FROM f UNION SELECT file, target FROM u WHERE alias IS NULL AND NOT is_static
  UNION SELECT b.file, target FROM u JOIN f a USING (file) JOIN f b ON coalesce(a.project, '') = coalesce(b.project, '') WHERE is_global),
q AS (SELECT file, name FROM ({REFS_SQL}) UNION SELECT file, target FROM u WHERE is_static),
x AS (SELECT q.file, q.name, CASE WHEN al.target IS NULL THEN q.name ELSE al.target || substr(q.name, 2) END AS path, contains(q.name, '.') AS whole FROM q LEFT JOIN (SELECT file, max(target) AS target FROM u WHERE alias = 'A' GROUP BY 1) al ON al.file = q.file AND split_part(q.name, '.', 1) = 'A'),
l AS (SELECT file, name, max(length(full_)) AS n FROM x JOIN (SELECT DISTINCT full_ FROM t) ON path = full_ OR starts_with(path, full_ || '.') WHERE whole GROUP BY 1, 2),
r0 AS (SELECT x.file, x.name, t.name AS type, t.namespace, t.file AS target, visibility, true AS whole FROM l JOIN x USING (file, name) JOIN t ON (path = full_ OR starts_with(path, full_ || '.')) AND length(full_) = n
  UNION ALL SELECT x.file, x.name, t.name, t.namespace, t.file, visibility, false FROM x JOIN t ON t.name = x.name WHERE NOT whole AND (x.file, t.namespace) IN (SELECT (file, namespace) FROM v)),
r AS (SELECT r0.*, CASE WHEN a.project = b.project THEN 0 WHEN (a.project, b.project) IN (SELECT (project, referenced) FROM j) THEN 1 ELSE 2 END AS rank FROM r0 LEFT JOIN f a ON a.file = r0.file LEFT JOIN f b ON b.file = r0.target WHERE visibility = 'public' OR a.project IS NULL OR b.project IS NULL OR a.project = b.project),
m AS (SELECT file, name, count(DISTINCT namespace) AS spaces, min(rank) AS best FROM r WHERE NOT whole GROUP BY 1, 2), b AS (SELECT r.file, r.name, count(DISTINCT namespace) AS n FROM r JOIN m USING (file, name) WHERE NOT whole AND rank = best GROUP BY 1, 2),
z AS (SELECT DISTINCT file, name, target, type FROM r WHERE whole UNION SELECT r.file, r.name, target, type FROM r JOIN m USING (file, name) JOIN b USING (file, name) WHERE NOT whole AND (spaces = 1 OR (rank = best AND b.n = 1)))"""


def _resolved(spark, sf):
    return symbols.resolved(*(P.view(spark, sf, text) for text in (TYPES_SQL, FILES_SQL, DECLARED_SQL, USINGS_SQL, REFS_SQL, PROJECTS_SQL)))


@query("types_resolved", f"WITH {RESOLVED} SELECT * FROM z")
def _(spark, sf):
    return _resolved(spark, sf)


@query("symbol_edges", f"WITH {RESOLVED} SELECT file AS source, target, array_to_string(list_sort(list(DISTINCT type)), ',') AS names FROM z WHERE file <> target GROUP BY 1, 2")
def _(spark, sf):
    return symbols.symbol_edges(_resolved(spark, sf)).withColumn("names", F.array_join("names", ","))
