"""Queries over findings: listing, analytics, lifecycle, replay and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions.scalars import relative_path
from sondage.operators import findings as op, states
from sondage.registry import query
from sondage.session import table
from sondage.sources import projection as P

WITH = f"WITH f AS ({P.FINDINGS_SQL}), r AS ({P.RULES_SQL})"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
NAME = "['critical', 'high', 'medium', 'low', 'info'][r + 1]"
SHOWN = ("id", "rule_key", "severity", "status", "file_path")
DISABLED = "SELECT rule_key FROM r WHERE number IN (3, 7)"


def _disabled(spark, sf):
    return P.rules(spark, sf).where("number in (3, 7)")


@query("findings_breakdown", f"{WITH} SELECT string_split(rule_key, '/')[1] AS category, severity, count(*) AS n FROM f GROUP BY 1, 2")
def _(spark, sf):
    return op.breakdown(P.findings(spark, sf))


@query("findings_list", f"""{WITH} SELECT {', '.join(SHOWN)} FROM f WHERE status IN ('new', 'unchanged') AND rule_key NOT IN ({DISABLED})
ORDER BY {RANK}, created_at DESC, id LIMIT 50 OFFSET 20""")
def _(spark, sf):
    return op.list_findings(P.findings(spark, sf), _disabled(spark, sf), limit=50, offset=20).select(*SHOWN)


@query("findings_by_status", f"{WITH} SELECT {', '.join(SHOWN)} FROM f WHERE status = 'resolved'")
def _(spark, sf):
    return op.with_status(P.findings(spark, sf), "resolved").select(*SHOWN)


@query("findings_in_file", f"{WITH} SELECT {', '.join(SHOWN)} FROM f WHERE status IN ('new', 'unchanged') AND type = 'code' AND file_path = '/repo/svc1/mod11.ts' AND rule_key NOT IN ({DISABLED})")
def _(spark, sf):
    return op.list_findings(P.findings(spark, sf), _disabled(spark, sf), file_path="/repo/svc1/mod11.ts").select(*SHOWN)


@query("findings_of_severity", f"{WITH} SELECT {', '.join(SHOWN)} FROM f WHERE severity IN ('critical', 'high') AND rule_key NOT IN ({DISABLED})")
def _(spark, sf):
    return op.list_findings(P.findings(spark, sf), _disabled(spark, sf), status="all", severities=("Critical", "HIGH")).select(*SHOWN)


@query("findings_enabled", f"{WITH} SELECT {', '.join(SHOWN)} FROM f WHERE rule_key NOT IN ({DISABLED})")
def _(spark, sf):
    return op.enabled(P.findings(spark, sf), _disabled(spark, sf)).select(*SHOWN)


@query("findings_with_names", f"""{WITH}, m AS ({P.MODULES_SQL})
SELECT f.id, m.name AS module_name, m.layer, n.n_name AS nation_name, g.r_name AS region_name
FROM f LEFT JOIN m ON f.user_id = m.module_id LEFT JOIN nation n ON f.user_id % 40 = n.n_nationkey LEFT JOIN region g ON n.n_regionkey = g.r_regionkey""")
def _(spark, sf):
    f, m = P.findings(spark, sf), P.modules(spark, sf)
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        f.join(m.select("module_id", F.col("name").alias("module_name"), "layer"), F.col("user_id") == F.col("module_id"), "left")
        .join(n, F.col("user_id") % 40 == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("id", "module_name", "layer", F.col("n_name").alias("nation_name"), F.col("r_name").alias("region_name"))
    )


@query("rules_enabled", f"{WITH} SELECT rule_key, category, kind FROM r WHERE category IN ('error', 'view') AND kind = 'code' AND number NOT IN (3, 7)")
def _(spark, sf):
    rules = P.rules(spark, sf).where(F.col("category").isin("error", "view") & (F.col("kind") == "code"))
    return op.enabled(rules, _disabled(spark, sf)).select("rule_key", "category", "kind")


@query("findings_location_invariant", f"""{WITH} SELECT id, CASE WHEN ok THEN file_path END AS file_path, CASE WHEN ok THEN line_start END AS line_start, CASE WHEN ok THEN line_end END AS line_end
FROM (SELECT *, line_start IS NOT NULL AND line_end IS NOT NULL AS ok FROM f)""")
def _(spark, sf):
    return op.location_invariant(P.findings(spark, sf).select("id", "file_path", "line_start", "line_end"))


@query("findings_relative_paths", f"{WITH} SELECT DISTINCT CASE WHEN starts_with(file_path, '/repo/svc1/') THEN substr(file_path, 12) ELSE file_path END AS path FROM f")
def _(spark, sf):
    return P.findings(spark, sf).select(relative_path(F.col("file_path"), "/repo/svc1").alias("path")).distinct()


@query("findings_by_file", f"{WITH} SELECT file_path, total, {NAME} AS highest FROM (SELECT file_path, count(*) AS total, min({RANK}) AS r FROM f GROUP BY 1)")
def _(spark, sf):
    return op.file_summary(P.findings(spark, sf))


@query("top_offenders", f"""{WITH}, c AS (
  SELECT 'service' AS kind, service AS name, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM f WHERE service IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'module', module, count(*), count(*) FILTER (severity = 'critical'), count(*) FILTER (severity = 'high') FROM f WHERE module IS NOT NULL GROUP BY 2)
SELECT kind, name, total, critical, high FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY total DESC, critical DESC, high DESC, name) AS k FROM c)
WHERE k <= 10 ORDER BY total DESC, critical DESC, high DESC, kind, name LIMIT 10""")
def _(spark, sf):
    return op.top_offenders(P.findings(spark, sf))


HISTORY = """h AS (SELECT CAST(day AS VARCHAR) AS run, day AS created_at, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (severity = 'critical') AS critical, count(DISTINCT service) AS services, count(DISTINCT module) AS modules FROM f GROUP BY day)"""


def _history(spark, sf):
    f = P.findings(spark, sf)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "resolved")]
    return f.groupBy(F.col("day").alias("created_at")).agg(*counts, F.count_if(F.col("severity") == "critical").alias("critical"), F.countDistinct("service").alias("services"), F.countDistinct("module").alias("modules")).withColumn("run", F.col("created_at").cast("string"))


@query("run_history", f"{WITH}, {HISTORY} SELECT run, new, unchanged, resolved, critical, services, modules FROM h")
def _(spark, sf):
    return _history(spark, sf).drop("created_at")


@query("trend", f"{WITH}, {HISTORY} SELECT run, new, resolved FROM h WHERE created_at <= DATE '2024-01-20' ORDER BY created_at DESC LIMIT 10")
def _(spark, sf):
    return op.trend(_history(spark, sf), 10, "2024-01-20").select("run", "new", "resolved")


RESOLVED = """a AS (SELECT id, created_at AS added_at FROM f), z AS (SELECT id, created_at + (id % 9 - 2) * INTERVAL 12 HOUR AS resolved_at FROM f WHERE id % 3 = 0)"""


@query("resolution", f"""{WITH}, {RESOLVED}, p AS (SELECT a.id, added_at, resolved_at, (epoch_ms(resolved_at) - epoch_ms(added_at)) / 3600000.0 AS hours FROM a LEFT JOIN z USING (id))
SELECT count(*) AS total, count(resolved_at) AS resolved, CAST(floor(avg(hours) FILTER (hours > 0) * 10 + 0.5) AS DOUBLE) AS mean_tenths,
  CAST(floor(count(resolved_at) * 1.0 / count(*) * 100 + 0.5) AS BIGINT) AS rate,
  count(*) FILTER (resolved_at IS NULL AND added_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS stale FROM p""")
def _(spark, sf):
    f = P.findings(spark, sf)
    added = f.select("id", F.col("created_at").alias("added_at"))
    resolved = f.where("id % 3 = 0").selectExpr("id", "created_at + make_interval(0, 0, 0, 0, cast(12 * (id % 9 - 2) as int)) AS resolved_at")
    return op.resolution(added, resolved, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("active_summary", f"{WITH} SELECT severity, count(*) AS n FROM f WHERE status IN ('new', 'unchanged') GROUP BY 1")
def _(spark, sf):
    return op.with_status(P.findings(spark, sf)).groupBy("severity").agg(F.count("*").alias("n"))


@query("usage_summary", """SELECT event_type AS provider, count(*) AS calls, CAST(sum(user_id * 10) AS BIGINT) AS tokens,
  CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 6))) FILTER (event_id % 3 <> 0) AS DECIMAL(28, 6)) AS cost, arg_max(event_type || CAST(user_id AS VARCHAR), event_id) FILTER (user_id % 2 = 1) AS last_model FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    cost = F.when(F.col("event_id") % 3 != 0, F.round("value", 2).cast("decimal(18,6)"))
    model = F.when(F.col("user_id") % 2 == 1, F.concat("event_type", F.col("user_id").cast("string")))
    return e.groupBy(F.col("event_type").alias("provider")).agg(
        F.count("*").alias("calls"), F.sum(F.col("user_id") * 10).alias("tokens"), F.sum(cost).alias("cost"),
        F.max_by(model, F.when(model.isNotNull(), F.col("event_id"))).alias("last_model"),
    )


@query("drift_summary", f"""{WITH} SELECT s.severity, count(f.id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info'), ('blocker')) s(severity) LEFT JOIN f ON f.severity = s.severity AND f.type = 'module' GROUP BY 1""")
def _(spark, sf):
    from sondage.functions.scalars import SEVERITIES

    f = P.findings(spark, sf).where("type = 'module'").groupBy("severity").agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in (*SEVERITIES, "blocker")])).alias("severity"))
    return names.join(f, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


NEWEST = "(SELECT max(day) FROM f)"
BEFORE = f"(SELECT max(day) FROM f WHERE day < {NEWEST})"
DAYS = f"c AS (SELECT * FROM f WHERE day = {NEWEST}), p AS (SELECT * FROM f WHERE day = {BEFORE})"


def _newest(f):
    """The rows of the newest day there is; one day is compared with, so it may be broadcast."""
    return f.join(F.broadcast(f.agg(F.max("day").alias("__day"))), F.col("day") == F.col("__day")).drop("__day")


def _days(spark, sf):
    """The findings of the newest day and of the one before it."""
    f = P.findings(spark, sf).withColumn("first_seen", F.col("day"))
    older = f.join(F.broadcast(f.agg(F.max("day").alias("__day"))), F.col("day") < F.col("__day")).drop("__day")
    return _newest(f), _newest(older)


@query("file_lifecycle", f"""{WITH}, {DAYS}, l AS (SELECT rule_key, file_path, max(id) AS previous_id, arg_max(day, id) AS seen FROM p GROUP BY 1, 2)
SELECT c.rule_key, c.file_path, c.id, CASE WHEN l.previous_id IS NULL THEN 'new' ELSE 'unchanged' END AS status, coalesce(l.seen, c.day) AS first_seen, l.previous_id
FROM c LEFT JOIN l USING (rule_key, file_path)
UNION ALL SELECT rule_key, file_path, id, 'resolved', day, id FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rule_key = p.rule_key AND c.file_path = p.file_path)""")
def _(spark, sf):
    return op.lifecycle(*_days(spark, sf), ["rule_key", "file_path"])


@query("deterministic_states", f"""{WITH}, {DAYS}, a AS (SELECT DISTINCT rule_key, service, title FROM c), b AS (SELECT DISTINCT rule_key, service, title FROM p)
SELECT rule_key, service, title, CASE WHEN NOT inp THEN 'new' WHEN NOT inc THEN 'resolved' ELSE 'unchanged' END AS status
FROM (SELECT rule_key, service, title, bool_or(s = 1) AS inc, bool_or(s = 2) AS inp FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY 1, 2, 3)""")
def _(spark, sf):
    return op.compare_states(*_days(spark, sf), ["rule_key", "service", "title"])


@query("titled_lifecycle", f"""{WITH}, {DAYS}, t AS (SELECT lower(trim(title)) AS k, min(id) AS old_id FROM p GROUP BY 1)
SELECT c.id, t.old_id, CASE WHEN t.old_id IS NULL THEN 'new' ELSE 'replaced' END AS status FROM c LEFT JOIN t ON lower(trim(c.title)) = t.k""")
def _(spark, sf):
    c, p = _days(spark, sf)
    old = p.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.min("id").alias("old_id"))
    return c.join(old, F.lower(F.trim("title")) == F.col("k"), "left").select("id", "old_id", F.when(F.col("old_id").isNull(), "new").otherwise("replaced").alias("status"))


LOG = "g AS (SELECT user_id AS id, CAST(day - DATE '2024-01-01' AS BIGINT) AS run, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'resolved' ELSE 'added' END AS op FROM f GROUP BY 1, 2)"


@query("replay", f"{WITH}, {LOG} SELECT id, last_run FROM (SELECT id, max(run) AS last_run, arg_max(op, run) AS op FROM g WHERE run <= 17 GROUP BY id) WHERE op = 'added'")
def _(spark, sf):
    f = P.findings(spark, sf)
    log = f.groupBy(F.col("user_id").alias("id"), F.datediff("day", F.lit("2024-01-01")).cast("long").alias("run")).agg(F.when(F.count_if(F.col("severity") == "critical") > 0, "resolved").otherwise("added").alias("op"))
    return op.replay(log, 17)


@query("active_after_diff", f"{WITH} SELECT id FROM f WHERE day = {BEFORE} AND id % 6 <> 0 UNION SELECT id FROM f WHERE day = {NEWEST} AND id % 4 = 0")
def _(spark, sf):
    c, p = _days(spark, sf)
    return states.active_set(p, c.where("id % 4 = 0"), p.where("id % 6 = 0"))


@query("affected_nodes", f"""{WITH}, ch AS (SELECT DISTINCT file_path FROM f WHERE day = {NEWEST} AND severity = 'critical')
SELECT DISTINCT kind, key FROM (SELECT 'service' AS kind, service AS key FROM f SEMI JOIN ch USING (file_path) UNION ALL SELECT 'module', service || '::' || module FROM f SEMI JOIN ch USING (file_path) WHERE module IS NOT NULL)""")
def _(spark, sf):
    f = P.findings(spark, sf)
    changed = _newest(f).where("severity = 'critical'").select("file_path").distinct()
    hit = f.join(changed, "file_path", "left_semi").select("service", "module").distinct()
    both = hit.select(F.lit("service").alias("kind"), F.col("service").alias("key")).unionByName(hit.where("module is not null").select(F.lit("module").alias("kind"), F.concat_ws("::", "service", "module").alias("key")))
    return both.distinct()


@query("diff_by_key", f"""{WITH}, {DAYS}, b AS (SELECT title, count(*) AS n FROM p GROUP BY 1), h AS (SELECT title, count(*) AS n FROM c GROUP BY 1)
SELECT coalesce(b.title, h.title) AS title, CASE WHEN b.n IS NULL THEN 'added' WHEN h.n IS NULL THEN 'removed' ELSE 'unchanged' END AS change, coalesce(h.n, b.n) AS n FROM b FULL JOIN h ON b.title = h.title""")
def _(spark, sf):
    c, p = _days(spark, sf)
    return op.diff_keys(p, c, "title")


@query("diff_contents", """WITH b AS (SELECT doc_id, source AS x FROM documents WHERE doc_id % 3 <> 0), h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS x FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(b.doc_id, h.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN h.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL JOIN h ON b.doc_id = h.doc_id WHERE b.doc_id IS NULL OR h.doc_id IS NULL OR b.x IS DISTINCT FROM h.x""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    base = d.where("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("x"))
    head = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.col("source")).alias("x"))
    return op.diff_contents(base, head, "doc_id", "x")


@query("diff_drifts", f"""{WITH}, {DAYS}, b AS (SELECT *, row_number() OVER (PARTITION BY rule_key, module ORDER BY id) AS k FROM p), h AS (SELECT *, row_number() OVER (PARTITION BY rule_key, module ORDER BY id) AS k FROM c)
SELECT coalesce(h.rule_key, b.rule_key) AS rule_key, coalesce(h.module, b.module) AS module, coalesce(h.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
FROM (SELECT * FROM b WHERE k = 1 AND module IS NOT NULL) b FULL JOIN (SELECT * FROM h WHERE k = 1 AND module IS NOT NULL) h ON b.rule_key = h.rule_key AND b.module = h.module""")
def _(spark, sf):
    c, p = _days(spark, sf)
    h, b = (op.first_of(x.where("module is not null"), ["rule_key", "module"], ["id"]) for x in (c, p))
    return h.select("rule_key", "module", F.col("id").alias("hid")).join(b.select("rule_key", "module", F.col("id").alias("bid")), ["rule_key", "module"], "full_outer").select(
        "rule_key", "module", F.coalesce("hid", "bid").alias("id"), F.when(F.col("bid").isNull(), "added").when(F.col("hid").isNull(), "resolved").otherwise("unchanged").alias("change"))


@query("distinct_first", f"{WITH} SELECT title, id, rule_key FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY created_at, id) AS k FROM f) WHERE k = 1")
def _(spark, sf):
    return op.first_of(P.findings(spark, sf), ["title"], ["created_at", "id"]).select("title", "id", "rule_key")


@query("occurrence_index", f"{WITH} SELECT id, CAST(row_number() OVER (PARTITION BY title, rule_key ORDER BY file_path, line_start NULLS FIRST, id) - 1 AS INT) AS occurrence FROM f")
def _(spark, sf):
    f = P.findings(spark, sf).select("id", "file_path", F.col("line_start").alias("line"), F.col("title").alias("symbol"), F.col("rule_key").alias("obligation"))
    return op.occurrence_index(f).select("id", "occurrence")


@query("stable_keys", f"{WITH} SELECT DISTINCT sha256(service || chr(31) || coalesce(module, '')) AS key, service, module FROM f")
def _(spark, sf):
    pairs = P.findings(spark, sf).select("service", "module").distinct()
    return pairs.select(F.sha2(F.concat(F.col("service"), F.lit("\x1f"), F.coalesce("module", F.lit(""))).cast("binary"), 256).alias("key"), "service", "module")


@query("debounced_changes", """WITH e AS (SELECT user_id % 5 AS root, ts, user_id AS path, lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT root, min(ts) AS started, count(*) AS n, count(DISTINCT path) AS n_paths FROM s GROUP BY root, k""")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("root"), "ts", F.col("user_id").alias("path"))
    return op.debounce(e, "10 minutes")
