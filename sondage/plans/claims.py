"""Queries of claim consolidation, over conversations and documents as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import claims as op
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P

CLAIMS_SQL = """SELECT event_id AS id, event_type AS topic, 's' || CAST(user_id % 40 AS VARCHAR) AS subject,
CASE WHEN event_id % 19 = 0 THEN ' ' ELSE 'value ' || CAST((user_id * 3 + event_id % 4) % 4 AS VARCHAR) END AS content,
CASE event_id % 7 WHEN 0 THEN 'shipped' WHEN 1 THEN 'deferred' WHEN 2 THEN 'deprecated' WHEN 3 THEN 'out-of-scope' END AS status,
CASE event_id % 6 WHEN 0 THEN 'adr' WHEN 1 THEN 'spec' WHEN 2 THEN 'readme' WHEN 3 THEN 'unknown' WHEN 4 THEN 'runbook' ELSE 'prd' END AS doc_kind,
ts AS touched, 'docs/' || event_type || '-v' || CAST(user_id % 6 AS VARCHAR) || '.md' AS file FROM events"""
WITH = f"WITH c AS ({CLAIMS_SQL})"
FULL = ", e AS (SELECT *, trim(content) <> '' AS full_, max(CASE WHEN trim(content) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY topic, subject) AS any_ FROM c), w AS (SELECT * FROM e WHERE full_ OR any_ = 0)"
LIVE = FULL + ", v AS (SELECT *, status IS NULL OR status = 'shipped' AS live_, max(CASE WHEN status IS NULL OR status = 'shipped' THEN 1 ELSE 0 END) OVER (PARTITION BY topic, subject) AS some_ FROM w), l AS (SELECT * FROM v WHERE live_ OR some_ = 0)"
RANK = "CASE doc_kind WHEN 'adr' THEN 4 WHEN 'rfc' THEN 4 WHEN 'prd' THEN 3 WHEN 'spec' THEN 3 WHEN 'design-note' THEN 2 WHEN 'runbook' THEN 2 WHEN 'readme' THEN 1 ELSE 0 END"
PRIORITY = "CASE coalesce(status, '') WHEN 'shipped' THEN 4 WHEN 'deferred' THEN 2 WHEN 'out-of-scope' THEN 1 WHEN 'deprecated' THEN 0 ELSE 3 END"
SETTLED = LIVE + f""", r AS (SELECT *, {RANK} AS rk, row_number() OVER (PARTITION BY topic, subject ORDER BY {RANK} DESC, epoch(date_trunc('second', touched)) DESC, length(content) DESC, id) AS k1,
row_number() OVER (PARTITION BY topic, subject ORDER BY {PRIORITY} DESC, epoch(date_trunc('second', touched)) DESC, id) AS k2 FROM l),
g AS (SELECT topic, subject, count(*) AS n, count(DISTINCT content || chr(31) || coalesce(status, '')) AS prints, count(DISTINCT content) AS contents, max(rk) AS top,
min(id) FILTER (k1 = 1) AS first_id, min(id) FILTER (k2 = 1) AS kept_id FROM r GROUP BY 1, 2),
t AS (SELECT r.topic, r.subject, count(*) FILTER (rk = top) AS at_top, max(rk) FILTER (rk < top) AS second FROM r JOIN g ON r.topic = g.topic AND r.subject = g.subject GROUP BY 1, 2),
s AS (SELECT g.topic, g.subject, n, CASE WHEN prints = 1 THEN 'identical' WHEN contents = 1 THEN 'status' WHEN at_top = 1 AND top - second >= 3 THEN 'dominance' ELSE 'conflict' END AS how,
CASE WHEN contents = 1 THEN kept_id ELSE first_id END AS chosen FROM g JOIN t ON g.topic = t.topic AND g.subject = t.subject)"""


def _claims(spark, sf):
    return P.view(spark, sf, CLAIMS_SQL)


def _live(spark, sf):
    return op.live(op.without_empty(_claims(spark, sf)))


@query("claims_without_empty", f"{WITH}{FULL} SELECT id FROM w")
def _(spark, sf):
    return op.without_empty(_claims(spark, sf)).select("id")


@query("claims_live", f"{WITH}{LIVE} SELECT id FROM l")
def _(spark, sf):
    return _live(spark, sf).select("id")


@query("claims_settled", f"{WITH}{SETTLED} SELECT * FROM s")
def _(spark, sf):
    return op.settle(_live(spark, sf))


CONFLICTS = SETTLED + """, o AS (SELECT l.topic, l.subject, chosen, sha256(array_to_string(list_sort(list(DISTINCT sha256(content))), ',')) AS conflict_id, count(DISTINCT content) AS candidates
FROM l JOIN s ON l.topic = s.topic AND l.subject = s.subject WHERE how = 'conflict' GROUP BY 1, 2, 3)"""


@query("claim_conflicts", f"{WITH}{CONFLICTS} SELECT topic, subject, chosen, conflict_id, candidates FROM o")
def _(spark, sf):
    c = _live(spark, sf)
    return op.conflicts(c, op.settle(c))


@query("claim_decisions", f"{WITH}{CONFLICTS} SELECT conflict_id, chosen, false AS decided FROM o WHERE conflict_id NOT LIKE '1%' UNION ALL SELECT conflict_id, -1, true FROM o WHERE conflict_id LIKE '1%'")
def _(spark, sf):
    c = _live(spark, sf)
    open_ = op.conflicts(c, op.settle(c))
    taken = open_.where("conflict_id like '1%'").select("conflict_id").distinct().select("conflict_id", F.lit(-1).cast("long").alias("picked"), F.lit(1).alias("resolved_at"))
    return op.decide(open_, taken)


@query("version_chains", """WITH d AS (SELECT DISTINCT 'docs/' || event_type || '-v' || CAST(user_id % 6 AS VARCHAR) || '.md' AS path, event_type, user_id % 6 AS v FROM events)
SELECT older, newer FROM (SELECT path AS older, lead(path) OVER (PARTITION BY event_type ORDER BY v) AS newer FROM d) WHERE newer IS NOT NULL""")
def _(spark, sf):
    docs = table(spark, sf, "events").select(F.concat(F.lit("docs/"), "event_type", F.lit("-v"), (F.col("user_id") % 6).cast("string"), F.lit(".md")).alias("path")).distinct()
    return op.version_chains(docs)


@query("claims_of_newest_versions", f"{WITH}, h AS (SELECT topic, max(file) AS f FROM c GROUP BY 1) SELECT id FROM c JOIN h ON c.topic = h.topic AND c.file = h.f")
def _(spark, sf):
    c = _claims(spark, sf)
    return op.superseded(c, op.version_chains(c.select(F.col("file").alias("path")).distinct())).select("id")


@query("claim_modules", """WITH w AS (SELECT conv_id * 100 + turn AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2))) AS w FROM conversations),
m AS (SELECT * FROM (VALUES ('alpha', 'the'), ('alpha', 'and'), ('beta', 'der'), ('beta', 'und'), ('beta', 'the'), ('gamma', 'que')) t(module, w)),
h AS (SELECT id, module, count(*) AS n FROM w JOIN m ON w.w = m.w GROUP BY 1, 2), b AS (SELECT id, module, row_number() OVER (PARTITION BY id ORDER BY n DESC, module) AS k FROM h)
SELECT conv_id * 100 + turn AS id, coalesce(b.module, '_shared') AS module FROM conversations LEFT JOIN b ON b.id = conv_id * 100 + turn AND k = 1""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    modules = spark.createDataFrame([("alpha", ["the", "and"]), ("beta", ["der", "und", "the"]), ("gamma", ["que"])], "module string, tokens array<string>")
    return op.attribute(c, modules)


FRAGMENTS = "SELECT p_type AS kind, p_brand AS identity, p_size % 5 AS rank, p_partkey % 4 AS specificity, p_partkey AS ordinal, 'b' || CAST(p_partkey % 3 AS VARCHAR) AS body FROM part"


@query("merged_fragments", f"""WITH f AS ({FRAGMENTS}), k AS (SELECT *, row_number() OVER (PARTITION BY kind, identity ORDER BY rank DESC, specificity DESC, ordinal) AS k, max(rank) OVER (PARTITION BY kind, identity) AS top FROM f),
b AS (SELECT kind, identity, ordinal AS chosen, body, top FROM k WHERE k = 1), d AS (SELECT DISTINCT kind, identity, body AS other FROM k WHERE rank = top)
SELECT b.kind, b.identity, chosen, count(*) FILTER (other <> body) AS clashing FROM b JOIN d ON b.kind = d.kind AND b.identity = d.identity GROUP BY 1, 2, 3""")
def _(spark, sf):
    return op.merge_fragments(P.view(spark, sf, FRAGMENTS))


@query("claim_slices", f"{WITH} SELECT subject AS module, topic, count(*) AS n, sha256(string_agg(content, chr(10) ORDER BY id)) AS hash FROM c GROUP BY 1, 2")
def _(spark, sf):
    return op.slices(_claims(spark, sf).withColumn("module", F.col("subject")))
