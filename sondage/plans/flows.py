"""Queries over calls between services."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions.scalars import severity_rank
from sondage.operators import flows as op
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P

METHODS = "SELECT p_partkey AS method_id, 's' || CAST(p_size % 7 AS VARCHAR) AS service, CASE WHEN p_size % 7 > 4 THEN 'api' WHEN p_partkey % 2 = 0 THEN 'service' ELSE 'data' END AS layer, p_partkey % 3 = 0 AS exported, p_name AS name FROM part"


@query("flow_entry_points", f"""WITH m AS ({METHODS}), o AS (SELECT service, method_id FROM m WHERE exported AND layer = 'api'),
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY CASE layer WHEN 'service' THEN 1 ELSE 2 END, method_id) AS k FROM m WHERE exported AND layer <> 'api' AND service NOT IN (SELECT service FROM o))
SELECT service, method_id FROM o UNION ALL SELECT service, method_id FROM r WHERE k = 1""")
def _(spark, sf):
    return op.entry_points(P.view(spark, sf, METHODS))


@query("flow_steps", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 <> 0 AND l_returnflag = 'R' THEN 'http' WHEN l_suppkey % 3 <> 0 THEN 'cross-service'
WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN 'db-write' WHEN l_linestatus = 'O' AND l_linenumber % 3 = 1 THEN 'db-read' ELSE 'call' END AS kind FROM lineitem""")
def _(spark, sf):
    name = F.element_at(F.array(F.lit("saveAll"), F.lit("findOne"), F.lit("audit")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    kind = op.step_kind(F.col("l_suppkey") % 3 == 0, F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "data").otherwise("api"), name)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("address_services", """SELECT url, CASE WHEN h LIKE '%.example.com' THEN 'com' WHEN h LIKE '%.example.org' THEN 'org' END AS service
FROM (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages) WHERE h LIKE '%.example.com' OR h LIKE '%.example.org'""")
def _(spark, sf):
    known = spark.createDataFrame([("example.com", "com"), ("example.org", "org")], "host string, service string")
    return op.services_of(table(spark, sf, "pages").select("url").distinct(), known)


@query("imports_through_barrels", """WITH i AS (SELECT DISTINCT l_orderkey % 50 AS source, 1000 + l_suppkey % 4 AS target, l_linenumber AS name FROM lineitem),
r AS (SELECT 1000 + k % 4 AS barrel, n AS name, k * 10 + n AS origin FROM (SELECT unnest(range(0, 3)) AS k), (SELECT unnest(range(1, 5)) AS n))
SELECT DISTINCT source, coalesce(origin, target) AS target, i.name FROM i LEFT JOIN r ON i.target = barrel AND i.name = r.name WHERE source <> coalesce(origin, target)""")
def _(spark, sf):
    i = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("source"), (1000 + F.col("l_suppkey") % 4).alias("target"), F.col("l_linenumber").alias("name")).distinct()
    r = spark.createDataFrame([(1000 + k % 4, n, k * 10 + n) for k in range(3) for n in range(1, 5)], "barrel long, name int, origin long")
    return op.through_barrels(i, r)


@query("edge_severities", f"""WITH f AS ({P.FINDINGS_SQL}), i AS ({P.IMPORTS_SQL}), w AS (SELECT user_id AS node, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS r FROM f GROUP BY 1)
SELECT source, target, CAST(least(a.r, b.r) AS INT) AS worst FROM i LEFT JOIN w a ON source = a.node LEFT JOIN w b ON target = b.node""")
def _(spark, sf):
    found = P.findings(spark, sf).withColumn("node", F.col("user_id"))
    return op.worst_per_edge(P.imports(spark, sf), found, severity_rank(F.col("severity")))


@query("kept_runs", "SELECT o_orderkey AS run, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS INT) AS age, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20 AS kept FROM orders")
def _(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("branch"), F.col("o_orderdate").alias("created_at"))
    return op.nth_versions(runs, 20).select("run", "age", "kept")
