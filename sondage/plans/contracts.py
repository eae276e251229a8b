"""Queries of contract comparison."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from sondage.operators import contracts as op
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P

SPEC_OPS = "SELECT 'GET /' || lower(c_mktsegment) || '/' || CAST(c_nationkey AS VARCHAR) AS operation, max(CASE c_custkey % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'deprecated' ELSE 'active' END) AS spec_status FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1"
CODE_OPS = "SELECT DISTINCT 'GET /' || lower(c_mktsegment) || '/' || CAST(c_nationkey AS VARCHAR) AS operation FROM customer WHERE c_custkey % 7 = 1"


@query("compare_operations", f"""WITH s AS ({SPEC_OPS}), c AS ({CODE_OPS}), j AS (SELECT coalesce(s.operation, c.operation) AS operation, spec_status, c.operation IS NOT NULL AS here FROM s FULL JOIN c ON s.operation = c.operation)
SELECT operation, drift FROM (SELECT operation, CASE WHEN NOT here AND coalesce(spec_status, '') NOT IN ('planned', 'deferred', 'out-of-scope') THEN 'operation-missing'
WHEN here AND spec_status IN ('out-of-scope', 'deprecated') THEN 'operation-unwanted' WHEN spec_status IS NULL THEN 'operation-undocumented' END AS drift FROM j) WHERE drift IS NOT NULL""")
def _(spark, sf):
    return op.compare_operations(P.view(spark, sf, SPEC_OPS), P.view(spark, sf, CODE_OPS))


LEFT = "SELECT p_brand AS key, array_agg(DISTINCT p_size) AS items FROM part WHERE p_partkey % 3 = 0 AND p_brand <> 'Brand#11' GROUP BY 1"
RIGHT = "SELECT p_brand AS key, array_agg(DISTINCT p_size) AS items FROM part WHERE p_partkey % 5 = 0 AND p_brand <> 'Brand#12' GROUP BY 1"


@query("corpus_diff", f"""WITH a AS ({LEFT}), b AS ({RIGHT}) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS side,
CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN CAST(len(list_filter(a.items, lambda x: NOT list_contains(b.items, x))) AS INT) END AS missing FROM a FULL JOIN b ON a.key = b.key""")
def _(spark, sf):
    return op.corpus_diff(P.view(spark, sf, LEFT), P.view(spark, sf, RIGHT)).withColumn("missing", F.when(F.col("side") == "both", F.col("missing")))


@query("obligation_coverage", f"""WITH a AS ({LEFT}), b AS ({RIGHT}) SELECT a.key, round(len(list_filter(a.items, lambda x: list_contains(coalesce(b.items, []), x))) * 1.0 / len(a.items), 6) AS ratio FROM a LEFT JOIN b ON a.key = b.key""")
def _(spark, sf):
    return op.coverage(P.view(spark, sf, LEFT), P.view(spark, sf, RIGHT))


@query("layered_contracts", "SELECT p_partkey AS k, 'primary' AS layer FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'base' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    return op.layered(p.where("k % 3 = 0").withColumn("layer", F.lit("primary")), p.where("k % 2 = 0").withColumn("layer", F.lit("base")), "k")


@query("dangling_references", """WITH a AS (SELECT DISTINCT p_brand || '.' || p_size AS identity FROM part WHERE p_size < 20 UNION SELECT DISTINCT p_brand FROM part WHERE p_size = 30),
r AS (SELECT DISTINCT p_brand || '.' || p_size AS ref FROM part) SELECT ref FROM r WHERE ref NOT IN (SELECT identity FROM a) AND regexp_replace(ref, '\\.[^.]*$', '') NOT IN (SELECT identity FROM a)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    ref = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    known = p.where("p_size < 20").select(ref.alias("identity")).union(p.where("p_size = 30").select("p_brand"))
    return op.dangling(p.select(ref.alias("ref")).distinct(), known)


ENUM_SPEC = "SELECT 'e' || CAST(p_size AS VARCHAR) AS name, array_agg(DISTINCT CAST(p_partkey % (p_size % 5 + 3) AS VARCHAR)) AS values FROM part GROUP BY 1"
ENUM_CODE = "SELECT CASE WHEN p_size % 2 = 0 THEN 'e' ELSE 'x' END || CAST(p_size AS VARCHAR) AS code_name, array_agg(DISTINCT CAST(p_partkey % (p_size % 6 + 3) AS VARCHAR)) AS code_values FROM part GROUP BY 1"
ENUM_SQL = f"""WITH s AS ({ENUM_SPEC}), c AS ({ENUM_CODE}), p AS (SELECT name, code_name, len(list_intersect(values, code_values)) AS i, len(values) AS a, len(code_values) AS b FROM s, c),
q AS (SELECT *, i * 1.0 / (a + b - i) AS overlap FROM p), n AS (SELECT name, code_name, overlap FROM q WHERE name = code_name),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY overlap DESC, code_name) AS k FROM q WHERE name NOT IN (SELECT name FROM n) AND i > 0 AND overlap >= 0.6 AND abs(a - b) <= 2 AND (a >= 3 OR overlap = 1)),
m AS (SELECT * FROM n UNION ALL SELECT name, code_name, overlap FROM r WHERE k = 1)"""


@query("match_enums", f"{ENUM_SQL} SELECT name, code_name, round(overlap, 6) AS overlap FROM m")
def _(spark, sf):
    return op.match_enums(P.view(spark, sf, ENUM_SPEC), P.view(spark, sf, ENUM_CODE)).withColumn("overlap", F.round("overlap", 6))


@query("compare_enums", f"""{ENUM_SQL}, j AS (SELECT s.name, s.values, m.code_name, c.code_values FROM s LEFT JOIN m ON s.name = m.name LEFT JOIN c ON m.code_name = c.code_name)
SELECT name, 'no-code-counterpart' AS drift, NULL AS value FROM j WHERE code_name IS NULL
UNION ALL SELECT name, 'missing-value', v FROM (SELECT name, code_values, unnest(values) AS v FROM j WHERE code_name IS NOT NULL) WHERE NOT list_contains(code_values, v)
UNION ALL SELECT name, 'extra-value', v FROM (SELECT name, values, unnest(code_values) AS v FROM j WHERE code_name IS NOT NULL) WHERE NOT list_contains(values, v)""")
def _(spark, sf):
    s, c = P.view(spark, sf, ENUM_SPEC), P.view(spark, sf, ENUM_CODE)
    return op.compare_enums(s, c, op.match_enums(s, c))


STEPS = """WITH w AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT DISTINCT 'u' || CAST(user_id % 3 AS VARCHAR) AS entity, event_type AS a, nxt AS b FROM w WHERE nxt IS NOT NULL"""


@query("compare_transitions", f"""WITH c AS ({STEPS}), d AS (SELECT * FROM (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view')) t(a, b))
SELECT entity, a AS "from", b AS "to", CASE WHEN a = 'purchase' THEN 'illegal-regression' ELSE 'undocumented-transition' END AS drift FROM c WHERE (a, b) NOT IN (SELECT (a, b) FROM d)""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("to", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("to is not null")
    code = e.select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("entity"), F.col("event_type").alias("from"), "to").distinct()
    known = spark.createDataFrame([(a, b, f"u{k}") for a, b in (("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")) for k in range(3)], "`from` string, `to` string, entity string")
    return op.compare_transitions(known.select("entity", "from", "to"), code, F.col("from") == "purchase")


REQUIRED = "SELECT p_brand AS entity, 'status' AS col, 'in' AS kind, array_agg(CAST(p_size % 4 AS VARCHAR)) AS vals FROM part WHERE p_type = 'ECONOMY' AND p_retailprice < 950 GROUP BY 1"
FOUND = "SELECT p_brand AS entity, 'status' AS col, 'in' AS kind, p_container AS q, array_agg(CAST(p_size % 4 AS VARCHAR)) AS vals FROM (SELECT p_brand, p_size, p_partkey % 3 AS p_container, p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1, 4"


@query("compare_predicates", f"""WITH r AS ({REQUIRED}), f AS ({FOUND}), w AS (SELECT entity, list_sort(list_distinct(vals)) AS want FROM r), h AS (SELECT entity, list(DISTINCT list_sort(list_distinct(vals))) AS haves FROM f GROUP BY 1)
SELECT w.entity, 'status' AS "column", CASE WHEN haves IS NULL THEN 'predicate-missing' ELSE 'value-mismatch' END AS drift FROM w LEFT JOIN h ON w.entity = h.entity WHERE haves IS NULL OR NOT list_contains(haves, want)""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("v", (F.col("p_size") % 4).cast("string"))
    r = p.where("p_type = 'ECONOMY' and p_retailprice < 950").groupBy(F.col("p_brand").alias("entity")).agg(F.collect_list("v").alias("values"))
    f = p.where("p_type = 'SMALL'").groupBy(F.col("p_brand").alias("entity"), (F.col("p_partkey") % 3).alias("q")).agg(F.collect_list("v").alias("values"))
    named = [x.withColumn("column", F.lit("status")).withColumn("kind", F.lit("in")) for x in (r, f)]
    return op.compare_predicates(*named)


QUERIES_SQL = "SELECT DISTINCT l_shipmode AS tab, l_orderkey AS query_id, pred FROM (SELECT CAST(l_orderkey % 3000 AS VARCHAR) AS l_shipmode, l_orderkey, 'p' || CAST(l_linenumber AS VARCHAR) AS pred FROM lineitem WHERE l_quantity > 3)"


@query("consensus_predicates", f"""WITH q AS ({QUERIES_SQL}), n AS (SELECT tab, count(DISTINCT query_id) AS n FROM q GROUP BY 1), k AS (SELECT tab, pred, count(DISTINCT query_id) AS k FROM q GROUP BY 1, 2)
SELECT k.tab AS "table", pred AS predicate, n AS queries FROM k JOIN n ON k.tab = n.tab WHERE k = n AND n >= 2""")
def _(spark, sf):
    q = P.view(spark, sf, QUERIES_SQL).select(F.col("tab").alias("table"), "query_id", F.col("pred").alias("predicate"))
    return op.consensus(q)


@query("date_range_columns", """SELECT l_orderkey AS query_id, l_returnflag AS "column" FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_linenumber % 4 IN (0, 1)) AND bool_or(l_linenumber % 4 IN (2, 3))""")
def _(spark, sf):
    ops = F.element_at(F.array(*[F.lit(x) for x in ("gt", "gte", "lt", "lte")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("column"), ops.alias("op"))
    return op.date_range_columns(p)


@query("unprotected_operations", "SELECT c_custkey AS operation FROM customer WHERE c_acctbal > 0 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, sf):
    ops = table(spark, sf, "customer").select(F.col("c_custkey").alias("operation"), "c_acctbal", F.col("c_nationkey").alias("file"))
    return op.unprotected(ops, table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("file")), F.col("c_acctbal") > 0).select("operation")


@query("missing_channels", """WITH g AS (SELECT p_brand AS field, list(DISTINCT CAST(p_size % 3 AS VARCHAR)) AS got FROM part WHERE p_size > 48 AND p_partkey % 2 = 0 GROUP BY 1), x AS (SELECT DISTINCT p_brand AS field FROM part),
j AS (SELECT x.field, got, list_sort(list_filter(['0', '1', '2'], lambda v: NOT list_contains(coalesce(got, []), v))) AS lack FROM x LEFT JOIN g ON x.field = g.field)
SELECT field, CASE WHEN got IS NULL THEN 'not-exposed' ELSE 'channel-missing' END AS drift, array_to_string(lack, ',') AS lack FROM j WHERE len(lack) > 0""")
def _(spark, sf):
    p = table(spark, sf, "part")
    want = p.select(F.col("p_brand").alias("field")).distinct().withColumn("channels", F.array(*[F.lit(x) for x in "012"]))
    got = p.where("p_size > 48 and p_partkey % 2 = 0").select(F.col("p_brand").alias("field"), (F.col("p_size") % 3).cast("string").alias("channel"))
    return op.missing_channels(want, got)


@query("compare_constants", """WITH s AS (SELECT DISTINCT 'App.' || p_brand AS name, CAST(p_size % 2 AS VARCHAR) AS want FROM part WHERE p_size < 4),
c AS (SELECT DISTINCT 'cfg.' || p_brand AS name, CAST(p_size % 3 AS VARCHAR) AS have FROM part WHERE p_size < 3 AND p_brand < 'Brand#2'),
k AS (SELECT regexp_replace(lower(string_split(name, '.')[2]), '[^a-z0-9.]', '', 'g') AS last, list(DISTINCT have) AS h FROM c GROUP BY 1)
SELECT name, CASE WHEN h IS NOT NULL THEN 1 END AS stage, CASE WHEN h IS NULL THEN 'no-code-counterpart' ELSE 'value-mismatch' END AS drift
FROM s LEFT JOIN k ON regexp_replace(lower(string_split(name, '.')[2]), '[^a-z0-9.]', '', 'g') = last WHERE h IS NULL OR NOT list_contains(h, want)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = p.where("p_size < 4").select(F.concat(F.lit("App."), "p_brand").alias("name"), (F.col("p_size") % 2).cast("string").alias("value")).distinct()
    c = p.where("p_size < 3 and p_brand < 'Brand#2'").select(F.concat(F.lit("cfg."), "p_brand").alias("name"), (F.col("p_size") % 3).cast("string").alias("value")).distinct()
    return op.compare_constants(s, c)
