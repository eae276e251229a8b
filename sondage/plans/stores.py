"""Queries that write states to the snapshot store and read them at a commit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sondage.operators.graph import shared_folder
from sondage.registry import query
from sondage.sources import projection as P
from sondage.sources.snapshots import SnapshotStore
from sondage.streaming.recompute import FindingsState

#: Drifts: a rule's state in a file, as each fifth of the findings' days finds it; a third of the findings takes it away.
DRIFTS_SQL = """SELECT rule_key, file_path, id, severity, status = 'resolved' AS gone, CAST(floor(datediff('day', DATE '2024-01-01', day) / 6.0) AS INT) AS step FROM f"""
_WITH = f"WITH f AS ({P.FINDINGS_SQL}), d AS ({DRIFTS_SQL}), l AS (SELECT rule_key, file_path, step, arg_max(severity, id) AS severity, arg_max(gone, id) AS gone, max(id) AS id FROM d GROUP BY 1, 2, 3)"


def _store(spark, sf):
    """A store with a full state and the changes of each further step, as commits s0, s1, ..."""
    step = F.floor(F.datediff("day", F.lit("2024-01-01")) / 6.0).cast("int")
    found = P.findings(spark, sf).select("rule_key", "file_path", "id", "severity", (F.col("status") == "resolved").alias("gone"), step.alias("step"))
    last = found.groupBy("rule_key", "file_path", "step").agg(F.max_by(F.struct("severity", "gone", "id"), "id").alias("r")).select("rule_key", "file_path", "step", "r.*")
    store = SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", "drifts", ["rule_key", "file_path"])
    for k in range(4):
        here = last.where(F.col("step") == k)
        rows, gone = here.where("not gone").drop("step", "gone"), here.where("gone")
        if k:
            store.write_changes("repo", f"s{k}", f"2024-{k:02}", rows, gone)
        else:
            store.write_full("repo", "s0", "2024-00", rows)
    return store


@query("store_at_commit", f"{_WITH} SELECT rule_key, file_path, arg_max(severity, step) AS severity, arg_max(id, step) AS id FROM l WHERE step BETWEEN 0 AND 2 GROUP BY 1, 2 HAVING NOT arg_max(gone, step)")
def _(spark, sf):
    return _store(spark, sf).read("repo", "s2")


@query("store_diff", f"""{_WITH}, a AS (SELECT rule_key, file_path, arg_max(severity, step) AS severity, arg_max(id, step) AS id FROM l WHERE step BETWEEN 0 AND 1 GROUP BY 1, 2 HAVING NOT arg_max(gone, step)),
b AS (SELECT rule_key, file_path, arg_max(severity, step) AS severity, arg_max(id, step) AS id FROM l WHERE step BETWEEN 0 AND 3 GROUP BY 1, 2 HAVING NOT arg_max(gone, step))
SELECT rule_key, file_path, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (rule_key, file_path) WHERE a.id IS NULL OR b.id IS NULL OR a.id <> b.id OR a.severity <> b.severity""")
def _(spark, sf):
    store = _store(spark, sf)
    store.compact("repo", "s1")
    return store.diff("repo", "s1", "s3")


#: What one user did on a day is a scan of a file; views are scans that found nothing.
SCANS_SQL = "SELECT 'f' || CAST(user_id AS VARCHAR) AS file_path, event_type AS rule_key, CAST(ts AS DATE) AS day FROM events"


@query("findings_incremental", f"""WITH s AS (SELECT DISTINCT file_path, datediff('day', DATE '2024-01-01', day) AS scan, CASE WHEN rule_key = 'view' THEN '' ELSE rule_key END AS rule_key FROM ({SCANS_SQL})),
k AS (SELECT *, dense_rank() OVER (PARTITION BY file_path ORDER BY scan) AS k FROM s), l AS (SELECT file_path, max(k) AS last FROM k GROUP BY 1), n AS (SELECT DISTINCT file_path, k, scan FROM k),
i AS (SELECT file_path, rule_key, scan, k, k - row_number() OVER (PARTITION BY file_path, rule_key ORDER BY k) AS g FROM k WHERE rule_key <> ''),
t AS (SELECT file_path, rule_key, min(scan) AS first_seen, max(scan) AS last_seen, max(k) AS k, row_number() OVER (PARTITION BY file_path, rule_key ORDER BY max(k) DESC) AS r FROM i GROUP BY file_path, rule_key, g)
SELECT t.file_path, rule_key, CASE WHEN t.k = last THEN 'active' ELSE 'resolved' END AS status, first_seen, last_seen, n.scan AS resolved_at FROM t JOIN l USING (file_path) LEFT JOIN n ON n.file_path = t.file_path AND n.k = t.k + 1 WHERE r = 1""")
def _(spark, sf):
    day = F.datediff("day", F.lit("2024-01-01")).cast("long")
    scans = P.view(spark, sf, SCANS_SQL).select("file_path", day.alias("scan"), F.when(F.col("rule_key") != "view", F.col("rule_key")).alias("rule_key"))
    state = FindingsState(spark, f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}", compact_every=2)
    for number, part in enumerate((2, 0, 1)):  # batches of days, out of order
        state.update(scans.where(F.col("scan") % 3 == part), number)
    return state.current()
