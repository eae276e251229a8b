"""Queries of the comparators, states and chains that stand beside the main ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions.scalars import severity_rank
from sondage.operators import chains, claims, states, verify
from sondage.plans.claims import CLAIMS_SQL, CONFLICTS
from sondage.registry import query
from sondage.session import table
from sondage.sources import javascript, projection as P

#: Fields of entities, by brand and size; assignments, by name and size.
FIELDS = "SELECT DISTINCT lower(p_type) AS entity, 'f' || CAST(p_size AS VARCHAR) AS field, p_size % 3 = 0 AS immutable, p_size % 5 = 0 AS lowercase FROM part"
WRITES = "SELECT 'file' || CAST(l_suppkey AS VARCHAR) AS file, CASE l_returnflag WHEN 'A' THEN 'economyRow' WHEN 'N' THEN 'this.SmallOne' ELSE 'x' END AS receiver, 'f' || CAST(l_quantity AS INT) AS field, l_linenumber AS line FROM lineitem"
MADE = "SELECT DISTINCT 'file' || CAST(l_suppkey AS VARCHAR) AS file, 'economy' AS entity, CASE WHEN l_linenumber = 1 THEN NULL ELSE 'f' || CAST(l_linenumber * 5 AS VARCHAR) END AS field FROM lineitem WHERE l_returnflag = 'R'"
LOWERS = "SELECT 'file' || CAST(s_suppkey AS VARCHAR) AS file FROM supplier WHERE s_acctbal > 3000"


@query("entity_drifts", f"""WITH f AS ({FIELDS}), a AS ({WRITES}), m AS ({MADE}), l AS ({LOWERS})
SELECT DISTINCT f.entity, f.field, 'mutability' AS obligation, a.file, CAST(line AS INT) AS line FROM a JOIN f ON a.field = f.field AND immutable AND contains(lower(receiver), lower(entity))
UNION SELECT f.entity, f.field, 'normalize', m.file, 1 FROM m JOIN f ON m.entity = f.entity AND lowercase AND (m.field IS NULL OR m.field = f.field) WHERE m.file NOT IN (SELECT file FROM l)""")
def _(spark, sf):
    return verify.entity_drifts(P.view(spark, sf, FIELDS), P.view(spark, sf, WRITES), P.view(spark, sf, MADE), P.view(spark, sf, LOWERS))


AUTH = "SELECT DISTINCT c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS operation, 'owner' || CAST(c_custkey % 3 AS VARCHAR) AS field FROM customer"
HANDLED = "SELECT DISTINCT c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS operation FROM customer WHERE c_acctbal > 2000"
COMPARED = "SELECT c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS operation, 'owner' || CAST(c_custkey % 3 AS VARCHAR) AS field FROM customer WHERE c_acctbal > 5000"


@query("authorization_drifts", f"WITH r AS ({AUTH}), h AS ({HANDLED}), c AS ({COMPARED}) SELECT operation, field FROM r WHERE operation IN (SELECT operation FROM h) AND (operation, field) NOT IN (SELECT (operation, field) FROM c)")
def _(spark, sf):
    return verify.authorization_drifts(*(P.view(spark, sf, q) for q in (AUTH, HANDLED, COMPARED)))


OPS = "['>', '<', '>=', '<=', '==', '!=']"
FORMULA_SPEC = f"SELECT DISTINCT p_brand || p_type AS formula, CASE WHEN p_partkey % 2 = 0 THEN 'qty ' || {OPS}[p_size % 6 + 1] || ' ' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || {OPS}[p_size % 6 + 1] || 'qty' END AS text, p_size % 6 AS k, p_size AS literal, p_partkey % 2 AS side FROM part"
FORMULA_CODE = f"SELECT DISTINCT p_brand || p_type AS formula, 'total' || {OPS}[p_size % 4 + 1] || CAST(p_size AS VARCHAR) AS text, {OPS}[p_size % 4 + 1] AS op, p_size AS literal FROM part WHERE p_retailprice < 1000"
FORMULA_INPUTS = "SELECT DISTINCT p_brand || p_type AS formula, CASE WHEN p_size % 4 = 0 THEN '_' ELSE '' END || 'in' || CAST(p_size % 7 AS VARCHAR) AS name, p_size % 9 <> 0 AS referenced FROM part"


@query("formula_drifts", f"""WITH s AS ({FORMULA_SPEC}), c AS ({FORMULA_CODE}), n AS ({FORMULA_INPUTS}), w AS (SELECT DISTINCT formula, literal, CASE WHEN side = 0 THEN {OPS}[k + 1] ELSE ['<', '>', '<=', '>=', '==', '!='][k + 1] END AS op FROM s)
SELECT DISTINCT formula, 'operator-mismatch' AS drift, op || ' ' || literal AS what FROM w WHERE (formula, literal) IN (SELECT (formula, literal) FROM c) AND (formula, literal, op) NOT IN (SELECT (formula, literal, op) FROM c)
UNION SELECT formula, 'input-unread', name FROM n WHERE formula IN (SELECT formula FROM c) AND (starts_with(name, '_') OR NOT referenced)""")
def _(spark, sf):
    spec, code = (P.view(spark, sf, q.replace("['>', '<', '>=', '<=', '==', '!=']", "array('>', '<', '>=', '<=', '==', '!=')").replace("% 6 + 1]", "% 6]").replace("% 4 + 1]", "% 4]")) for q in (FORMULA_SPEC, FORMULA_CODE))
    return verify.formula_drifts(spec.select("formula", "text"), code.select("formula", "text"), P.view(spark, sf, FORMULA_INPUTS))


@query("forbidden_predicates", """WITH q AS (SELECT l_returnflag AS entity, l_orderkey AS query_id, list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))) AS v FROM lineitem GROUP BY 1, 2)
SELECT entity, 'status' AS "column", query_id FROM q WHERE (entity = 'R' AND v = ['1', '2']) OR (entity = 'A' AND v = ['3'])""")
def _(spark, sf):
    found = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("entity"), F.col("l_orderkey").alias("query_id")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("values"))
    no = spark.createDataFrame([("R", ["2", "1", "2"]), ("A", ["3"])], "entity string, values array<string>")
    return verify.forbidden_predicates(*(x.withColumn("column", F.lit("status")).withColumn("kind", F.lit("in")) for x in (no, found)))


@query("query_rule_notes", """WITH q AS (SELECT o_orderpriority AS entity, o_orderkey AS query_id, o_orderstatus AS date_column, o_totalprice > 400000 AS unparseable FROM orders)
SELECT entity, query_id, CASE WHEN unparseable THEN 'unparseable' ELSE 'date-binding' END AS drift, CASE WHEN unparseable THEN 'info' ELSE 'medium' END AS severity FROM q WHERE unparseable OR (entity <> '5-LOW' AND date_column <> 'O')""")
def _(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("entity"), F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("date_column"), (F.col("o_totalprice") > 400000).alias("unparseable"))
    rules = q.select("entity").distinct().withColumn("date_column", F.when(F.col("entity") != "5-LOW", "O"))
    return verify.query_rule_notes(rules, q)


SUBSETS = "SELECT 'e' || CAST(p_size AS VARCHAR) AS name, CASE WHEN p_brand < 'Brand#15' THEN 'open' WHEN p_brand < 'Brand#20' THEN 'cloud-only' ELSE 'closed' END AS subset, array_agg(DISTINCT CAST(p_partkey % 9 AS VARCHAR)) AS values FROM part GROUP BY 1, 2"
COPIES = "SELECT 'e' || CAST(p_size AS VARCHAR) AS code_name, p_type AS copy, array_agg(DISTINCT CAST(p_partkey % 7 AS VARCHAR)) AS code_values FROM part WHERE p_size < 45 GROUP BY 1, 2"


@query("enum_subsets", f"""WITH s AS ({SUBSETS}), c AS ({COPIES}), u AS (SELECT code_name, list_distinct(flatten(list(code_values))) AS code_values FROM c GROUP BY 1)
SELECT DISTINCT name, subset, value FROM (SELECT name, subset, unnest(values) AS value FROM s WHERE subset <> 'cloud-only') x JOIN u ON name = code_name WHERE NOT list_contains(code_values, value)""")
def _(spark, sf):
    return verify.subset_drifts(P.view(spark, sf, SUBSETS), P.view(spark, sf, COPIES))


@query("drifts_as_findings", f"""WITH f AS ({P.FINDINGS_SQL}), o AS (SELECT doc_id AS artifact, source, n_chars FROM documents)
SELECT id, 'contract-drift/' || lower(severity) || '/' || title AS rule_key, severity, file_path, line_start, coalesce(source || ':' || n_chars, '') AS origin FROM f LEFT JOIN o ON user_id = artifact WHERE type <> 'module'""")
def _(spark, sf):
    f = P.findings(spark, sf).select("id", F.col("severity").alias("kind"), F.col("title").alias("obligation"), "severity", "file_path", "line_start", F.col("user_id").alias("artifact"), (F.col("type") == "module").alias("unenforceable"))
    origins = table(spark, sf, "documents").select(F.col("doc_id").alias("artifact"), "source", F.col("n_chars").alias("line"))
    return verify.as_findings(f, origins)


DECIDED = "SELECT p_type AS kind, p_name AS identity, max(p_brand) AS body FROM part WHERE p_size {where} GROUP BY 1, 2"


@query("decisions_diff", f"""WITH h AS ({DECIDED.format(where='< 12')}), b AS ({DECIDED.format(where='> 40')}), g AS (SELECT DISTINCT p_type AS kind, p_name AS identity FROM part WHERE p_size = 20), n AS (SELECT * FROM h WHERE (kind, identity) NOT IN (SELECT (kind, identity) FROM g))
SELECT coalesce(n.kind, b.kind) AS kind, coalesce(n.identity, b.identity) AS identity, CASE WHEN b.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'resolved' ELSE 'changed' END AS change
FROM n FULL JOIN b ON n.kind = b.kind AND n.identity = b.identity WHERE n.kind IS NULL OR b.kind IS NULL OR n.body <> b.body""")
def _(spark, sf):
    dropped = table(spark, sf, "part").where("p_size = 20").select(F.col("p_type").alias("kind"), F.col("p_name").alias("identity"))
    return verify.diff_decisions(P.view(spark, sf, DECIDED.format(where="< 12")), P.view(spark, sf, DECIDED.format(where="> 40")), dropped)


@query("findings_page", f"""WITH f AS ({P.FINDINGS_SQL}) SELECT id, severity, (SELECT count(*) FROM f) AS total FROM f
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, created_at DESC, id LIMIT 25 OFFSET 50""")
def _(spark, sf):
    return states.page(P.findings(spark, sf), 25, 50, severity_rank(F.col("severity")), F.desc("created_at"), "id").select("id", "severity", "total")


@query("resolved_graph", f"WITH f AS ({P.FINDINGS_SQL}) SELECT id, module FROM f WHERE day = (SELECT max(day) FROM f)")
def _(spark, sf):
    return states.resolved_graph(P.findings(spark, sf).withColumn("run", F.col("day"))).select("id", "module")


@query("diff_result", f"""WITH f AS ({P.FINDINGS_SQL}) SELECT status AS change, severity, count(*) AS n, max(day < (SELECT max(day) FROM f)) AS stale FROM f WHERE id % 12 NOT IN (3, 7) GROUP BY 1, 2""")
def _(spark, sf):
    f = P.findings(spark, sf)
    disabled = P.rules(spark, sf).where("number in (3, 7)")
    return states.diff_result(f.select(F.col("day").alias("base_run"), F.col("status").alias("change"), "rule_key", "severity"), disabled, f.select(F.col("day").alias("run")))


M_CALLS = """SELECT 's' || CAST(p_size % 4 AS VARCHAR) AS service, p_brand AS module, CASE p_partkey % 6 WHEN 0 THEN 'getAll' WHEN 1 THEN 'findById' WHEN 2 THEN 'createOne' WHEN 3 THEN 'removeMany' WHEN 4 THEN 'other' ELSE 'listAll' END AS method,
p_partkey AS call_id, CASE p_size % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS verb, CASE WHEN p_size % 2 = 0 THEN '/x/:id' ELSE '/x' END AS url FROM part WHERE p_type = 'PROMO'"""
M_NAMES = """SELECT 's' || CAST(p_size % 4 AS VARCHAR) AS service, p_brand AS module, CASE p_partkey % 6 WHEN 0 THEN 'getAll' WHEN 1 THEN 'findById' WHEN 2 THEN 'createOne' WHEN 3 THEN 'removeMany' WHEN 4 THEN 'other' ELSE 'listAll' END AS method FROM part"""


@query("method_calls", f"""WITH c AS ({M_CALLS}), m AS (SELECT DISTINCT * FROM ({M_NAMES})), x AS (SELECT service, module, method, min(call_id) AS exact FROM c GROUP BY 1, 2, 3),
k AS (SELECT service, module, count(*) AS n, min(call_id) AS only_id FROM c GROUP BY 1, 2), v AS (SELECT *, CASE WHEN regexp_matches(lower(method), '^(get|find|fetch|list|load|read|search|query)') THEN 'GET' WHEN regexp_matches(lower(method), '^(create|add|insert|save|register|post)') THEN 'POST'
WHEN regexp_matches(lower(method), '^(delete|remove|destroy|drop)') THEN 'DELETE' END AS verb, regexp_matches(lower(method), 'byid|one|single|byname|byemail|byslug|specific') AS one, regexp_matches(lower(method), 'all|list|many|multiple|every|batch') AS many FROM m),
t AS (SELECT v.service, v.module, v.method, count(call_id) AS fits, min(call_id) AS first_id, min(call_id) FILTER ((one AND url LIKE '%:id') OR (many AND url NOT LIKE '%:id')) AS told FROM v LEFT JOIN c ON c.service = v.service AND c.module = v.module AND c.verb = v.verb GROUP BY 1, 2, 3),
j AS (SELECT t.*, exact, coalesce(n, 0) AS n, only_id FROM t LEFT JOIN x ON t.service = x.service AND t.module = x.module AND t.method = x.method LEFT JOIN k ON t.service = k.service AND t.module = k.module)
SELECT service, module, method, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN only_id WHEN fits = 1 THEN first_id ELSE coalesce(told, first_id) END AS call_id,
CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'only' WHEN fits = 1 THEN 'verb' WHEN told IS NOT NULL THEN 'number' ELSE 'first' END AS how FROM j WHERE exact IS NOT NULL OR n = 1 OR fits > 0""")
def _(spark, sf):
    return states.method_calls(P.view(spark, sf, M_NAMES), P.view(spark, sf, M_CALLS))


@query("flows_not_reached", "SELECT 's' || CAST(s_nationkey AS VARCHAR) AS service, s_suppkey AS entry FROM supplier WHERE (s_nationkey, s_suppkey) NOT IN (SELECT (l_partkey % 25, l_suppkey) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 5)")
def _(spark, sf):
    flows = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("service"), F.col("s_suppkey").alias("entry"))
    steps = table(spark, sf, "lineitem").select(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 5), "http").otherwise("call").alias("kind"), F.concat(F.lit("s"), (F.col("l_partkey") % 25).cast("string")).alias("target_service"), F.col("l_suppkey").alias("target"), F.lit("outside").alias("entry_service"))
    return states.flows_not_reached(flows, steps)


@query("delegations", f"""WITH i AS ({P.IMPORTS_SQL}), f AS (SELECT s_suppkey AS entry, s_nationkey AS service FROM supplier WHERE s_acctbal < 7000), s AS (SELECT source AS entry, min(target) AS target FROM i GROUP BY 1),
d AS (SELECT s.entry, target FROM s JOIN supplier a ON a.s_suppkey = entry JOIN supplier b ON b.s_suppkey = target WHERE a.s_nationkey % 5 = b.s_nationkey % 5 AND entry <> target AND target IN (SELECT entry FROM f))
SELECT f.entry, d.target AS merged_into FROM f LEFT JOIN d ON f.entry = d.entry AND d.target NOT IN (SELECT entry FROM d)""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry"), (F.col("s_nationkey") % 5).alias("service"), "s_acctbal")
    other = s.select(F.col("entry").alias("target"), F.col("service").alias("target_service"))
    steps = P.imports(spark, sf).select(F.col("source").alias("entry"), "target").join(s.select("entry", F.col("service").alias("source_service")), "entry").join(other, "target").withColumn("position", F.col("target") + 2)
    return states.delegations(s.where("s_acctbal < 7000").select("entry"), steps)


FACTS = "SELECT event_id, event_type AS language, user_id % 4 = 0 AS is_test, array(event_type || '-lib', 'pg') AS imports, array('db.' || event_type, 'log') AS calls, array(named_struct('name', 'f', 'is_async', value > 50)) AS functions, CASE WHEN user_id % 3 = 0 THEN array('r') ELSE array() END AS routes, CASE WHEN value > 20 THEN 'try; catch (e);' END AS text FROM events"


@query("files_for_context", "SELECT event_id FROM events WHERE value > 50 AND user_id % 3 <> 0 AND event_type IN ('click', 'view', 'error') AND event_type LIKE '%i%' AND user_id % 4 <> 0 AND value > 20")
def _(spark, sf):
    want = states.file_filter(has_async=True, has_routes=False, imports_from=("click", "view"), calls_to=("db.",), test_file=False, languages=("click", "view", "error"), has_catch=True, database_packages=("pg",), has_database=True)
    return P.view(spark, sf, FACTS).where(want).select("event_id")


@query("unused_exports", """WITH x AS (SELECT DISTINCT c_mktsegment AS file, CASE WHEN c_nationkey < 5 THEN '0' || CAST(c_nationkey AS VARCHAR) WHEN c_nationkey < 10 THEN 'omer' ELSE 'r#0' || CAST(c_nationkey AS VARCHAR) END AS name FROM customer), y AS (SELECT DISTINCT c_mktsegment AS user, lower(replace(c_name, '#0000', '#0')) AS used FROM customer)
SELECT file, name FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.user <> x.file AND contains(used, name))""")
def _(spark, sf):
    x = P.view(spark, sf, "SELECT DISTINCT c_mktsegment AS file, CASE WHEN c_nationkey < 5 THEN '0' || CAST(c_nationkey AS VARCHAR) WHEN c_nationkey < 10 THEN 'omer' ELSE 'r#0' || CAST(c_nationkey AS VARCHAR) END AS name FROM customer")
    y = P.view(spark, sf, "SELECT DISTINCT c_mktsegment AS file, lower(replace(c_name, '#0000', '#0')) AS used FROM customer")
    return states.unused_exports(x, y)


@query("schema_columns", """WITH t AS (SELECT DISTINCT p_brand AS name, lower(p_brand) || '_alias' AS alias FROM part), c AS (SELECT p_brand AS tab, 'c' || p_size AS col, ['VARCHAR(20)', 'BigInteger', 'double precision', 'Geometry'][min(p_partkey) % 4 + 1] AS typ, min(p_partkey) % 4 AS k FROM part GROUP BY 1, 2),
u AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, CASE WHEN l_returnflag = 'A' THEN upper('Brand#' || (l_partkey % 30 + 1)) ELSE 'BRAND#' || (l_partkey % 30 + 1) || '_ALIAS' END AS tab, 'c' || CAST(l_quantity AS INT) AS col FROM lineitem)
SELECT use_id, t.name AS schema_table, u.col AS "column", ['string', 'bigint', 'float', 'geometry'][k + 1] AS type FROM u JOIN t ON lower(u.tab) IN (lower(t.name), lower(t.alias)) LEFT JOIN c ON c.tab = t.name AND c.col = u.col""")
def _(spark, sf):
    p = table(spark, sf, "part")
    tables = p.select(F.col("p_brand").alias("name"), F.concat(F.lower("p_brand"), F.lit("_alias")).alias("alias")).distinct()
    kinds = F.array(*[F.lit(k) for k in ("VARCHAR(20)", "BigInteger", "double precision", "Geometry")])
    columns = p.groupBy(F.col("p_brand").alias("table"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("column")).agg(F.get(kinds, (F.min("p_partkey") % 4).cast("int")).alias("type"))
    brand = F.concat(F.lit("BRAND#"), (F.col("l_partkey") % 30 + 1).cast("string"))
    uses = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), F.when(F.col("l_returnflag") == "A", brand).otherwise(F.concat(brand, F.lit("_ALIAS"))).alias("table"), F.concat(F.lit("c"), F.col("l_quantity").cast("int").cast("string")).alias("column"))
    return states.resolve_columns(uses, tables, columns)


@query("counted_cycles", f"""WITH i AS ({P.IMPORTS_SQL}), p AS (SELECT a.source AS a, a.target AS b, b.target AS c FROM i a JOIN i b ON a.target = b.source)
SELECT a || '-' || b || '-' || c AS cycle FROM p WHERE NOT (a % 2 = 0 AND b % 2 = 0 AND c % 2 = 0) AND NOT (a % 7 = 0 OR b % 7 = 0)""")
def _(spark, sf):
    i = P.imports(spark, sf)
    two = i.select(F.col("source").alias("a"), F.col("target").alias("b")).join(i.select(F.col("source").alias("b"), F.col("target").alias("c")), "b")
    cycles = two.select(F.concat_ws("-", *[F.col(x).cast("string") for x in "abc"]).alias("cycle"), F.array("a", "b", "c").alias("path"))
    models = P.modules(spark, sf).select(F.col("module_id").alias("node")).union(i.select("target")).where("node % 2 = 0")
    return states.exempt_cycles(cycles, models, i.withColumn("dynamic", F.col("source") % 7 == 0))


@query("file_services", """WITH f AS (SELECT DISTINCT CASE WHEN user_id % 10 = 0 THEN 'apps/a' || CAST(user_id % 50 AS VARCHAR) || '/package.json' ELSE 'apps/a' || CAST(user_id % 50 AS VARCHAR) || '/src/f' || CAST(user_id AS VARCHAR) || '.ts' END AS path FROM events)
SELECT path, CASE WHEN regexp_extract(path, '^(apps/a[0-9]+)/', 1) || '/package.json' IN (SELECT path FROM f) THEN regexp_extract(path, '^(apps/a[0-9]+)/', 1) ELSE '' END AS service FROM f""")
def _(spark, sf):
    f = P.view(spark, sf, "SELECT DISTINCT CASE WHEN user_id % 10 = 0 THEN 'apps/a' || CAST(user_id % 50 AS VARCHAR) || '/package.json' ELSE 'apps/a' || CAST(user_id % 50 AS VARCHAR) || '/src/f' || CAST(user_id AS VARCHAR) || '.ts' END AS path FROM events")
    return states.services_of_files(f)


CHAINS = "SELECT DISTINCT 'd' || CAST(least(l_suppkey, l_partkey % 97) AS VARCHAR) AS older, 'd' || CAST(greatest(l_suppkey, l_partkey % 97) AS VARCHAR) AS newer, CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'llm' ELSE 'filename' END AS source FROM lineitem WHERE l_suppkey <> l_partkey % 97"
CHAINED = f"m AS (SELECT older, newer, ['filename', 'llm', 'manual'][min(CASE source WHEN 'filename' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END)] AS source FROM ({CHAINS}) GROUP BY 1, 2), h AS (SELECT *, sha256(least(older, newer) || chr(10) || greatest(older, newer)) AS chain_id FROM m)"


@query("merged_chains", f"WITH {CHAINED} SELECT chain_id, older, newer, source FROM h")
def _(spark, sf):
    return chains.merged_sources(P.view(spark, sf, CHAINS))


@query("chain_stats", """WITH c AS (SELECT DISTINCT 'docs/' || event_type || '-v1.md' AS older, 'docs/' || event_type || '-v2.md' AS newer, event_type AS chain_id FROM events), f AS (SELECT chain_id, unnest([older, newer]) AS file FROM c),
k AS (SELECT 'docs/' || event_type || '-v' || CAST(user_id % 6 AS VARCHAR) || '.md' AS file, CASE WHEN value > 50 THEN 'auth' ELSE 'data' END AS topic, 's' || CAST(user_id % 40 AS VARCHAR) AS subject FROM events),
t AS (SELECT file, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(topic || '=' || n)), ',') AS topics FROM (SELECT file, topic, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT file, array_to_string(list(subject ORDER BY subject), ',') AS subjects FROM (SELECT file, subject, row_number() OVER (PARTITION BY file ORDER BY subject) AS r FROM (SELECT DISTINCT file, subject FROM k)) WHERE r <= 8 GROUP BY 1)
SELECT chain_id, f.file, coalesce(n, 0) AS n, coalesce(topics, '') AS topics, coalesce(subjects, '') AS subjects FROM f LEFT JOIN t ON f.file = t.file LEFT JOIN s ON f.file = s.file""")
def _(spark, sf):
    e = table(spark, sf, "events")
    name = lambda v: F.concat(F.lit("docs/"), "event_type", F.lit("-v"), v, F.lit(".md"))
    c = e.select(F.col("event_type").alias("chain_id"), name(F.lit("1")).alias("older"), name(F.lit("2")).alias("newer")).distinct()
    k = e.select(name((F.col("user_id") % 6).cast("string")).alias("file"), F.when(F.col("value") > 50, "auth").otherwise("data").alias("topic"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("subject"))
    return chains.chain_stats(c, k).select("chain_id", "file", "n", F.array_join("topics", ",").alias("topics"), F.array_join("subjects", ",").alias("subjects"))


RECHECK = "SELECT user_id % 30 AS conflict_id, 's' || CAST(user_id % 30 AS VARCHAR) AS subject, CASE WHEN value > 60 THEN 'prd' ELSE 'spec' END AS doc_kind, 'd' || CAST(event_id % 40 AS VARCHAR) AS file FROM events"
TOUCHED = "SELECT 'd' || CAST(s_suppkey AS VARCHAR) AS file, s_nationkey AS touched FROM supplier"


@query("recheck_pairs", f"""WITH k AS ({RECHECK}), d AS ({TOUCHED}), f AS (SELECT DISTINCT conflict_id, k.file, touched FROM k JOIN d ON k.file = d.file WHERE subject < 's2' AND doc_kind = 'prd'), c AS (SELECT DISTINCT older, newer FROM ({CHAINS}))
SELECT a.file AS older, b.file AS newer, min(a.conflict_id) AS conflict_id FROM f a JOIN f b ON a.conflict_id = b.conflict_id AND (a.touched < b.touched OR (a.touched = b.touched AND a.file < b.file)) WHERE (a.file, b.file) NOT IN (SELECT (older, newer) FROM c) GROUP BY 1, 2""")
def _(spark, sf):
    return chains.recheck_pairs(P.view(spark, sf, RECHECK), P.view(spark, sf, TOUCHED), P.view(spark, sf, CHAINS), F.col("subject") < "s2")


@query("artifact_identities", """WITH a AS (SELECT p_type AS kind, sha256(p_brand || CAST(p_size % 3 AS VARCHAR)) AS h, min(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, count(*) AS n FROM part GROUP BY 1, 2)
SELECT kind, CASE WHEN row_number() OVER (PARTITION BY kind, slug ORDER BY h) = 1 THEN slug ELSE slug || '-' || substr(h, 1, 8) END AS identity, n FROM a""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", (F.col("p_size") % 3).cast("string")).alias("body"))
    return chains.identities(p)


NEWEST = f"WITH c0 AS ({CLAIMS_SQL}), hh AS (SELECT topic, max(file) AS f FROM c0 GROUP BY 1), c AS (SELECT c0.* FROM c0 JOIN hh ON c0.topic = hh.topic AND c0.file = hh.f)"


@query("claims_remerged", f"{NEWEST}{CONFLICTS} SELECT s.topic, s.subject, CASE WHEN o.conflict_id LIKE '1%' THEN 'decision' ELSE how END AS how, CASE WHEN o.conflict_id LIKE '1%' THEN -1 ELSE s.chosen END AS chosen FROM s LEFT JOIN o ON s.topic = o.topic AND s.subject = o.subject")
def _(spark, sf):
    c = P.view(spark, sf, CLAIMS_SQL)
    known = claims.version_chains(c.select(F.col("file").alias("path")).distinct())
    rows = claims.live(claims.without_empty(claims.superseded(c, known)))
    open_ = claims.conflicts(rows, claims.settle(rows))
    taken = open_.where("conflict_id like '1%'").select("conflict_id").distinct().select("conflict_id", F.lit(-1).cast("long").alias("picked"), F.lit(1).alias("resolved_at"))
    return chains.remerge(c, known, taken)


def _scripts(spark, sf):
    """Each module as a file that imports what its edges say, calls it, and asks a service for a route of its own."""
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    line = F.concat(F.lit("import { run as "), name("target"), F.lit(" } from './"), name("target"), F.lit("';\n"))
    told = P.imports(spark, sf).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("imports"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), name("target"), F.lit("(x); // not("), name("target"), F.lit(")\n")))), "").alias("calls"))
    m = P.modules(spark, sf).join(told, F.col("module_id") == F.col("source"), "left")
    body = F.concat(F.coalesce("imports", F.lit("")), F.lit("export async function run(x) {\n"), F.coalesce("calls", F.lit("")), F.lit("}\nrouter.get('/"), name("module_id"), F.lit("/:id', run);\n"))
    return m.select(F.concat(F.lit("src/"), name("module_id"), F.lit(".ts")).alias("path"), body.alias("text"))


@query("javascript_imports", f"WITH i AS ({P.IMPORTS_SQL}), m AS ({P.MODULES_SQL}) SELECT 'src/m' || source || '.ts' AS source, 'src/m' || target || '.ts' AS target, 'run' AS name FROM i WHERE target IN (SELECT module_id FROM m)")
def _(spark, sf):
    files = _scripts(spark, sf)
    return javascript.import_targets(javascript.read_javascript(files), files)


@query("javascript_facts", f"""WITH i AS ({P.IMPORTS_SQL}), m AS ({P.MODULES_SQL}), n AS (SELECT source, count(*) AS n FROM i GROUP BY 1), x AS (SELECT 'src/m' || module_id || '.ts' AS path, module_id, CAST(coalesce(n, 0) AS INT) AS n FROM m LEFT JOIN n ON module_id = source)
SELECT path, 'function' AS kind, 'run' AS name, n + 1 AS line_start, 2 * n + 2 AS line_end FROM x UNION ALL SELECT path, 'route', 'GET', 2 * n + 3, 2 * n + 3 FROM x
UNION ALL SELECT 'src/m' || i.source || '.ts', 'call', 'm' || target, CAST(n + 1 + row_number() OVER (PARTITION BY i.source ORDER BY 'm' || target) AS INT), CAST(n + 1 + row_number() OVER (PARTITION BY i.source ORDER BY 'm' || target) AS INT) FROM i JOIN n ON i.source = n.source WHERE i.source IN (SELECT module_id FROM m)""")
def _(spark, sf):
    facts = javascript.read_javascript(_scripts(spark, sf))
    return facts.where("kind in ('function', 'route') or (kind = 'call' and name <> 'router.get')").select("path", "kind", "name", "line_start", "line_end")
