"""Queries of the further comparators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import graph, obligations as op
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P


def _part(spark, sf):
    return table(spark, sf, "part")


@query("missing_envelopes", "SELECT event_id FROM events WHERE 400 + user_id % 150 < 500 AND event_type <> 'error'")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", (400 + F.col("user_id") % 150).alias("status"), F.array("event_type").alias("fields"))
    return op.missing_envelopes(r, "4xx").select("event_id")


@query("pagination_drifts", """SELECT p_partkey AS operation, 'forbidden-parameter' AS drift, 'offset' AS parameter FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'limit-not-clamped', 'limit' FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 <> 0""")
def _(spark, sf):
    h = _part(spark, sf).select(F.col("p_partkey").alias("operation"), F.filter(F.array(F.when(F.col("p_size") % 3 == 0, "offset"), F.when(F.col("p_size") % 2 == 0, "limit")), lambda x: x.isNotNull()).alias("parameters"), (F.col("p_partkey") % 5 == 0).alias("clamped"))
    return op.pagination_drifts(h, ("offset", "page"))


@query("forbidden_artifacts", "SELECT DISTINCT p_type AS kind, p_brand AS name FROM part WHERE p_size = 7 AND (p_type, p_brand) IN (SELECT (p_type, p_brand) FROM part WHERE p_size = 9)")
def _(spark, sf):
    p = _part(spark, sf)
    pick = lambda n: p.where(F.col("p_size") == n).select(F.col("p_type").alias("kind"), F.col("p_brand").alias("name")).distinct()
    return op.forbidden_artifacts(pick(7), pick(9))


@query("effect_drifts", """WITH x AS (SELECT DISTINCT p_brand AS operation, p_type AS effect FROM part WHERE p_size < 40), m AS (SELECT p_brand AS operation, CASE WHEN p_size = 50 AND p_partkey % 9 = 0 THEN NULL ELSE p_type END AS effect FROM part WHERE p_size > 43)
SELECT operation, effect FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.operation = x.operation AND m.effect = x.effect) AND NOT EXISTS (SELECT 1 FROM m WHERE m.operation = x.operation AND m.effect IS NULL)""")
def _(spark, sf):
    p = _part(spark, sf)
    want = p.where("p_size < 40").select(F.col("p_brand").alias("operation"), F.col("p_type").alias("effect")).distinct()
    got = p.where("p_size > 43").select(F.col("p_brand").alias("operation"), F.when(~((F.col("p_size") == 50) & (F.col("p_partkey") % 9 == 0)), F.col("p_type")).alias("effect"))
    return op.effect_drifts(want, got)


@query("validation_conditions", """WITH s AS (SELECT DISTINCT p_brand || p_name AS target, CAST(p_size % 2 AS VARCHAR) AS e, CAST(p_size % 3 AS VARCHAR) AS c FROM part WHERE p_type = 'ECONOMY'),
k AS (SELECT DISTINCT regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS k, CAST(p_size % 2 AS VARCHAR) AS effect, CAST(p_size % 3 AS VARCHAR) AS condition FROM part WHERE p_type = 'SMALL'),
j AS (SELECT target, e, c, min(CASE WHEN effect IS NULL THEN 3 WHEN effect <> e THEN 2 WHEN condition <> c THEN 1 ELSE 0 END) AS r FROM s LEFT JOIN k ON regexp_replace(lower(target), '[^a-z0-9]', '', 'g') = k GROUP BY 1, 2, 3)
SELECT target, ['condition-mismatch', 'effect-mismatch', 'not-enforced'][r] AS drift FROM j WHERE r > 0""")
def _(spark, sf):
    p = _part(spark, sf).select(F.concat("p_brand", "p_name").alias("target"), (F.col("p_size") % 2).cast("string").alias("effect"), (F.col("p_size") % 3).cast("string").alias("condition"), "p_type")
    return op.conditions(p.where("p_type = 'ECONOMY'").drop("p_type").distinct(), p.where("p_type = 'SMALL'"))


@query("fallback_defaults", """WITH s AS (SELECT p_brand AS field, min(p_size % 4) AS value FROM part WHERE p_type = 'ECONOMY' GROUP BY 1), g AS (SELECT p_brand AS field, list(DISTINCT p_size % 4) AS have FROM part WHERE p_size = 50 GROUP BY 1)
SELECT s.field, CASE WHEN have IS NULL THEN 'not-applied' ELSE 'default-mismatch' END AS drift FROM s LEFT JOIN g ON s.field = g.field WHERE have IS NULL OR NOT list_contains(have, value)""")
def _(spark, sf):
    p = _part(spark, sf).select(F.col("p_brand").alias("field"), (F.col("p_size") % 4).alias("value"), "p_type", "p_size")
    return op.defaults(p.where("p_type = 'ECONOMY'").groupBy("field").agg(F.min("value").alias("value")), p.where("p_size = 50"))


@query("architecture_choices", """WITH d AS (SELECT p_brand AS topic, min(p_type) AS chosen FROM part GROUP BY 1), o AS (SELECT p_brand AS topic, list(DISTINCT p_type) AS seen FROM part WHERE p_size < 2 GROUP BY 1)
SELECT d.topic, CASE WHEN seen IS NULL THEN 'inconclusive' WHEN NOT list_contains(seen, chosen) THEN 'chosen-unmet' ELSE 'other-choice' END AS drift FROM d LEFT JOIN o ON d.topic = o.topic WHERE seen IS NULL OR len(seen) > 1 OR NOT list_contains(seen, chosen)""")
def _(spark, sf):
    p = _part(spark, sf)
    return op.choices(p.groupBy(F.col("p_brand").alias("topic")).agg(F.min("p_type").alias("chosen")), p.where("p_size < 2").select(F.col("p_brand").alias("topic"), F.col("p_type").alias("choice")))


@query("inferred_decisions", """WITH f AS (SELECT p_type AS kind, p_name AS name, lower(replace(p_brand, '#', '')) AS key FROM part), c AS (SELECT DISTINCT p_type, lower(replace(p_brand, '#', '')) AS key FROM part WHERE p_size < 8)
SELECT kind, key, min(name) AS name, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.p_type = f.kind AND c.key = f.key) GROUP BY 1, 2""")
def _(spark, sf):
    p = _part(spark, sf)
    key = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    covered = p.where("p_size < 8").select(F.col("p_type").alias("kind"), key.alias("key"))
    return op.inferred(p.select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), "p_brand"), covered, key)


@query("incomplete_contracts", """WITH c AS (SELECT p_partkey, ['Enum', 'StateMachine', 'QueryRule', 'Operation', 'Entity'][p_partkey % 5 + 1] AS kind, p_size FROM part)
SELECT kind, p_partkey AS identity, 'values' AS field FROM c WHERE kind = 'Enum' AND p_size % 2 = 0 UNION ALL SELECT kind, p_partkey, 'transitions' FROM c WHERE kind = 'StateMachine'
UNION ALL SELECT kind, p_partkey, 'states' FROM c WHERE kind = 'StateMachine' UNION ALL SELECT kind, p_partkey, 'predicates' FROM c WHERE kind = 'QueryRule'
UNION ALL SELECT kind, p_partkey, 'path' FROM c WHERE kind = 'Operation' UNION ALL SELECT kind, p_partkey, 'method' FROM c WHERE kind = 'Operation' AND p_size % 2 = 1""")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Enum", "StateMachine", "QueryRule", "Operation", "Entity")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    fields = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("method"))).otherwise(F.array(F.lit("values")))
    return op.incomplete(_part(spark, sf).select(kind.alias("kind"), F.col("p_partkey").alias("identity"), fields.alias("fields")))


@query("tagged_operations", """WITH t AS (SELECT s_nationkey AS g, list(DISTINCT 't' || CAST(s_suppkey % 4 AS VARCHAR)) AS more FROM supplier WHERE s_acctbal > 4000 GROUP BY 1)
SELECT c_custkey AS operation, array_to_string(list_sort(list_distinct(list_concat([c_mktsegment], coalesce(more, [])))), ',') AS tags FROM customer LEFT JOIN t ON c_nationkey = g""")
def _(spark, sf):
    ops = table(spark, sf, "customer").select(F.col("c_custkey").alias("operation"), F.array("c_mktsegment").alias("tags"), F.col("c_nationkey").alias("group"))
    tags = table(spark, sf, "supplier").where("s_acctbal > 4000").select(F.col("s_nationkey").alias("group"), F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string")).alias("tag"))
    return op.tagged(ops, tags).withColumn("tags", F.array_join("tags", ","))


@query("cache_plan", """SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 'extract' WHEN doc_id % 3 <> 0 THEN 'reuse' ELSE 'remove' END AS action FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 <> 0""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return op.cache_plan(d.where("id % 3 <> 0"), d.where("id % 5 <> 0"))


#: Five regions' nations in rings: of the first the edges are types alone, and one of the second is made at run time.
KINDED = "SELECT n_nationkey AS source, (n_nationkey + 1) % 5 + (n_nationkey // 5) * 5 AS target, n_nationkey < 5 AS type_only, n_nationkey = 7 AS dynamic FROM nation"


@query("cycle_kinds", "SELECT array_to_string(list_transform(range(0, 5), lambda x: x + g * 5), ',') AS cycle, CASE g WHEN 0 THEN 'type-only' WHEN 1 THEN 'dynamic' ELSE 'static' END AS kind FROM (SELECT DISTINCT n_nationkey // 5 AS g FROM nation)")
def _(spark, sf):
    edges = P.view(spark, sf, KINDED.replace("(n_nationkey // 5)", "(n_nationkey div 5)"))
    found = graph.short_cycles(edges, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("cycle"), "path")
    return op.cycle_kinds(found, edges)


@query("secret_literals", """WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS value FROM documents), l AS (SELECT doc_id || ':' || value AS id, value FROM t WHERE length(value) >= 16),
c AS (SELECT id, value, unnest(string_split(value, '')) AS ch, length(value) AS n FROM l), p AS (SELECT id, value, ch, count(*) * 1.0 / max(n) AS p FROM c GROUP BY 1, 2, 3),
b AS (SELECT id, value, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY 1, 2)
SELECT id, bits FROM b WHERE bits >= 3.5 AND NOT list_has_any(regexp_split_to_array(lower(value), '[^a-z0-9]+'), ['example', 'com', 'mail6'])""")
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("value"))
    stop = spark.createDataFrame([("example",), ("com",), ("mail6",)], "word string")
    return op.secret_literals(words.select(F.concat_ws(":", F.col("doc_id").cast("string"), "value").alias("id"), "value"), stop).select("id", "bits")
