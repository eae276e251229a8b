"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import scalars as S
from sondage.operators import classify as C
from sondage.registry import query
from sondage.session import table
from sondage.sources import code, projection as P

FILES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'api/v1' WHEN 2 THEN 'tests' ELSE 'docs/adr' END || '/' || event_type || CAST(user_id AS VARCHAR) ||
CASE event_id % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.test.js' WHEN 3 THEN '.cs' WHEN 4 THEN '.g.cs' WHEN 5 THEN '.md' ELSE '.tsx' END AS path,
event_type, user_id, CASE user_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'post' ELSE 'DELETE' END AS method FROM events"""


@query("glob_match", f"WITH f AS ({FILES}) SELECT event_id, path FROM f WHERE regexp_matches(path, '^(?:.*/)?v1/[^/]*\\.py$')")
def _(spark, sf):
    return P.view(spark, sf, FILES).where(S.glob_match(F.col("path"), "**/v1/*.py")).select("event_id", "path")


@query("languages", f"""WITH f AS ({FILES}) SELECT language, count(*) AS n FROM (SELECT CASE string_split(path, '.')[-1] WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'cs' THEN 'csharp' END AS language FROM f) GROUP BY 1""")
def _(spark, sf):
    return P.view(spark, sf, FILES).groupBy(C.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("test_files", f"WITH f AS ({FILES}) SELECT event_id FROM f WHERE regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|\\.(test|spec)\\.[a-z]+$')")
def _(spark, sf):
    return P.view(spark, sf, FILES).where(C.is_test(F.col("path"))).select("event_id")


HEADS = f"WITH f AS ({FILES}), t AS (SELECT event_id, path, CASE WHEN user_id % 6 = 0 THEN '// <AUTO-GENERATED/> by a tool' ELSE 'using x;' END AS text FROM f)"


@query("generated_sources", f"{HEADS} SELECT event_id FROM t WHERE regexp_matches(path, '\\.(g|generated|designer)\\.[a-z]+$') OR text LIKE '%<AUTO-GENERATED%'")
def _(spark, sf):
    text = F.when(F.col("user_id") % 6 == 0, "// <AUTO-GENERATED/> by a tool").otherwise("using x;")
    return P.view(spark, sf, FILES).where(C.is_generated(F.col("path"), text)).select("event_id")


@query("minified_pages", "SELECT page_id FROM pages WHERE strlen(html) >= 15360 AND length(substr(html, 1, 8192)) - length(replace(substr(html, 1, 8192), chr(10), '')) < 4")
def _(spark, sf):
    return table(spark, sf, "pages").where(C.looks_minified(F.col("html"))).select("page_id")


DOCS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'docs/specs/' WHEN 1 THEN 'docs/adr/' WHEN 2 THEN 'rfcs/' ELSE 'docs/' END || CASE event_id % 9 WHEN 3 THEN 'PRD-' WHEN 4 THEN 'runbook-' WHEN 5 THEN 'README-' WHEN 6 THEN 'ADR-7-' ELSE '' END || event_type || '.md' AS path,
CASE WHEN event_id % 9 = 7 THEN 'The Design of it' ELSE 'text' END AS text, event_id % 9 AS k FROM events"""


@query("doc_kinds", f"SELECT ['spec', 'adr', 'rfc', 'prd', 'runbook', 'readme', 'adr', 'design-note', 'unknown'][k + 1] AS kind, count(*) AS n FROM ({DOCS}) GROUP BY 1")
def _(spark, sf):
    return P.view(spark, sf, DOCS).groupBy(C.doc_kind(F.col("path"), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


TREE = {"kind": "all-of", "of": [{"kind": "any-of", "of": [{"kind": "path-glob", "value": "api/**"}, {"kind": "tag", "value": "purchase"}]}, {"kind": "none-of", "of": [{"kind": "method", "value": "delete"}, {"kind": "path-regex", "value": "[.]cs$"}]}]}


@query("selector", f"WITH f AS ({FILES}) SELECT event_id FROM f WHERE (regexp_matches(path, '^api/.*$') OR event_type = 'purchase') AND NOT upper(method) = 'DELETE' AND NOT regexp_matches(path, '[.]cs$')")
def _(spark, sf):
    return P.view(spark, sf, FILES).where(C.selector(TREE, F.col("path"), F.col("method"), F.array("event_type"))).select("event_id")


@query("entity_keys", "SELECT p_brand, regexp_replace(regexp_replace(lower(string_split('db.' || p_brand || '_Orders', '.')[-1]), '[_-]', '', 'g'), 's$', '') AS key, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", S.entity_key(F.concat(F.lit("db."), "p_brand", F.lit("_Orders"))).alias("key")).agg(F.count("*").alias("n"))


@query("enum_keys", "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type || 'Status'), '[^a-z0-9]', '', 'g'), '(enum|type|status|kind|values)$', '') AS key FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_type", S.enum_key(F.concat("p_type", F.lit("Status"))).alias("key")).distinct()


@query("slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("canonical_params", "SELECT DISTINCT event_type, '/x/' || event_type || '/{id}/' || '{part}' AS path FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_type", S.canonical_params(F.concat(F.lit("/x/"), "event_type", F.lit("/:id/<part>"))).alias("path")).distinct()


@query("name_entropy", """WITH c AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch, length(c_name) AS n FROM customer), s AS (SELECT c_custkey, ch, count(*) * 1.0 / max(n) AS p FROM c GROUP BY 1, 2)
SELECT c_custkey, round(-sum(p * log2(p)), 6) AS bits FROM s GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(S.entropy(F.col("c_name")), 6).alias("bits"))


@query("token_estimate", "SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(S.token_estimate(F.char_length("text"))).alias("tokens"))


@query("value_sets", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS key FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(S.value_set_key(F.collect_set("event_type")).alias("key"))


@query("rule_language_matrix", f"""WITH f AS ({FILES}), x AS (SELECT event_type AS rule, CASE string_split(path, '.')[-1] WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'cs' THEN 'csharp' END AS l FROM f)
SELECT rule, count(*) FILTER (l = 'csharp') AS csharp, count(*) FILTER (l = 'python') AS python, count(*) FILTER (l = 'typescript') AS typescript FROM x GROUP BY 1""")
def _(spark, sf):
    f = P.view(spark, sf, FILES).select(F.col("event_type").alias("rule"), C.language(F.col("path")).alias("l"))
    return f.groupBy("rule").pivot("l", ["csharp", "python", "typescript"]).agg(F.count(F.lit(1))).na.fill(0)


@query("database_instances", """WITH x AS (SELECT p_type AS kind, p_brand AS driver, 'svc' || CAST(p_size % 5 AS VARCHAR) AS service FROM part)
SELECT kind, count(DISTINCT driver) AS drivers, array_to_string(list_sort(list_distinct(list(service))), ',') AS services FROM x GROUP BY 1""")
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("driver"), F.concat(F.lit("svc"), (F.col("p_size") % 5).cast("string")).alias("service"))
    return x.groupBy("kind").agg(F.countDistinct("driver").alias("drivers"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))


@query("layers_of_files", """WITH x AS (SELECT s_suppkey, s_suppkey % 3 = 0 OR (s_suppkey % 5 = 0 AND s_nationkey > 5) AS api, s_suppkey % 2 = 0 AS data, s_suppkey % 7 = 0 AS ext FROM supplier)
SELECT s_suppkey, CASE WHEN api OR data OR ext THEN array_to_string(list_filter([CASE WHEN api THEN 'api' END, CASE WHEN data THEN 'data' END, CASE WHEN ext THEN 'external' END], lambda v: v IS NOT NULL), ',') ELSE 'service' END AS layers FROM x""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    pick = lambda n, a, b: F.when(F.col("s_suppkey") % n == 0, a).otherwise(b)
    imports = F.array(pick(2, "prisma", "lodash"), pick(3, "express", "zod"), pick(7, "axios", "fs"))
    return s.select("s_suppkey", F.array_join(C.layers(imports, pick(5, "src/api/x.ts", "src/x.ts"), F.when(F.col("s_nationkey") > 5, 2).otherwise(0)), ",").alias("layers"))


@query("markdown_blocks", r"""WITH t AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '## '), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM t),
v AS (SELECT *, length(regexp_extract(l, '^(#{1,6})\s', 1)) AS level FROM l), c AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM v)
SELECT doc_id, CAST(block AS BIGINT) AS block, max(level) AS level, sha256(string_agg(l, chr(10) ORDER BY k)) AS id FROM c GROUP BY 1, 2""")
def _(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")).alias("text"))
    return code.markdown_blocks(files).select(F.col("path").alias("doc_id"), "block", "level", "id")
