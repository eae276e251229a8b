"""Findings: listing, analytics, lifecycle between runs, replay and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sondage.functions.scalars import half_up, severity_name, severity_rank

ACTIVE = ("new", "unchanged")


def with_status(findings: DataFrame, status: str = "active") -> DataFrame:
    """``active`` is new and unchanged, ``all`` is all, any other status itself."""
    if status == "all":
        return findings
    return findings.where(F.col("status").isin(*ACTIVE) if status == "active" else F.col("status") == status)


def enabled(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings whose rule isn't disabled: a difference taken when reading, so that nothing is lost.

    The join broadcasts ``disabled`` only if the optimizer knows it to be small.
    """
    return findings.join(disabled.select("rule_key").distinct(), "rule_key", "left_anti")


def list_findings(findings: DataFrame, disabled: DataFrame, status: str = "active", file_path: str | None = None, severities: tuple[str, ...] = (), limit: int = 0, offset: int = 0) -> DataFrame:
    """Filtered, worst first, newest first, ties by id; limit 0 gives all, in this order, and ignores the offset."""
    rows = with_status(enabled(findings, disabled), status)
    if file_path is not None:
        rows = rows.where((F.col("file_path") == file_path) & (F.col("type") == "code"))
    if severities:
        rows = rows.where(F.lower("severity").isin(*[s.lower() for s in severities]))
    ordered = rows.orderBy(severity_rank(F.col("severity")), F.desc("created_at"), "id")
    if limit <= 0:
        return ordered
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def breakdown(findings: DataFrame) -> DataFrame:
    """Counts by the rule key's first part and severity, one shuffle of partial counts."""
    return findings.groupBy(F.split("rule_key", "/")[0].alias("category"), "severity").agg(F.count("*").alias("n"))


def file_summary(findings: DataFrame) -> DataFrame:
    rank = severity_rank(F.col("severity"))
    return findings.groupBy("file_path").agg(F.count("*").alias("total"), F.min(rank).alias("r")).select("file_path", "total", severity_name(F.col("r")).alias("highest"))


def top_offenders(findings: DataFrame, each: int = 10, overall: int = 10) -> DataFrame:
    """The services and modules with most findings: the first of each kind, then of both."""
    counts = (F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    order = [F.desc("total"), F.desc("critical"), F.desc("high"), "kind", "name"]
    kinds = [findings.where(F.col(k).isNotNull()).groupBy(F.lit(k).alias("kind"), F.col(k).alias("name")).agg(*counts).orderBy(*order).limit(each) for k in ("service", "module")]
    return kinds[0].unionByName(kinds[1]).orderBy(*order).limit(overall)


def trend(history: DataFrame, limit: int, up_to: str | None = None) -> DataFrame:
    """The last ``limit`` runs, the newest first, up to one of them; 0 or less gives all, in the same order."""
    rows = history
    if up_to is not None:
        last = history.where(F.col("run") == up_to).select(F.col("created_at").alias("t"))
        rows = history.join(F.broadcast(last.limit(1)), history["created_at"] <= F.col("t")).drop("t")
    ordered = rows.orderBy(F.desc("created_at"), F.desc("run"))
    return ordered if limit <= 0 else ordered.limit(limit)


def resolution(added: DataFrame, resolved: DataFrame, now: Column, stale_days: int = 7) -> DataFrame:
    """One row: totals, mean hours to resolve (of positive times), share resolved, stale ones."""
    pairs = added.join(resolved, "id", "left").withColumn("hours", (F.unix_millis(F.col("resolved_at").cast("timestamp")) - F.unix_millis(F.col("added_at").cast("timestamp"))) / 3600000.0)
    stale = F.col("resolved_at").isNull() & (F.col("added_at") < now - F.expr(f"INTERVAL {stale_days} DAYS"))
    out = pairs.agg(F.count("*").alias("total"), F.count("resolved_at").alias("resolved"), F.avg(F.when(F.col("hours") > 0, F.col("hours"))).alias("h"), F.count_if(stale).alias("stale"))
    return out.select("total", "resolved", half_up(F.col("h") * 10).cast("double").alias("mean_tenths"), half_up(F.when(F.col("total") > 0, F.col("resolved") / F.col("total") * 100)).cast("long").alias("rate"), "stale")


def lifecycle(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Current findings as new or unchanged with the first time seen, and previous ones as resolved.

    A key that occurs several times before stands for its last row by id; every
    current row of a known key is unchanged.
    """
    last = previous.groupBy(*keys).agg(F.max_by("id", "id").alias("previous_id"), F.max_by("first_seen", "id").alias("seen"))
    now = current.join(last, keys, "left").select(
        *keys, "id", F.when(F.col("previous_id").isNull(), "new").otherwise("unchanged").alias("status"),
        F.coalesce("seen", "first_seen").alias("first_seen"), "previous_id",
    )
    gone = previous.join(current.select(*keys).distinct(), keys, "left_anti")
    return now.unionByName(gone.select(*keys, "id", F.lit("resolved").alias("status"), "first_seen", F.col("id").alias("previous_id")))


def compare_states(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both sides with their state: new, unchanged or resolved."""
    a = current.select(*keys).distinct().withColumn("c", F.lit(True))
    b = previous.select(*keys).distinct().withColumn("p", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("unchanged").alias("status"))


def replay(log: DataFrame, run: Column | int) -> DataFrame:
    """The findings that are active after ``run``: per id the last event decides.

    log: id, run, op (added or resolved) and what a finding carries; within a
    run an addition follows a resolution.
    """
    order = F.struct("run", (F.col("op") == "added").alias("a"))
    return log.where(F.col("run") <= run).groupBy("id").agg(F.max_by("op", order).alias("op"), F.max("run").alias("last_run")).where("op = 'added'").drop("op")


def diff_keys(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """One row per key: added, removed or unchanged, with the number of rows on the side that has it."""
    a = base.groupBy(key).agg(F.count("*").alias("nb"))
    b = head.groupBy(key).agg(F.count("*").alias("nh"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("nb").isNull(), "added").when(F.col("nh").isNull(), "removed").otherwise("unchanged").alias("change"), F.coalesce("nh", "nb").alias("n"))


def diff_contents(base: DataFrame, head: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that were added, removed or have another content; equal ones drop out, nulls are equal."""
    joined = base.select(key, F.col(content).alias("b"), F.lit(1).alias("inb")).join(head.select(key, F.col(content).alias("h"), F.lit(1).alias("inh")), key, "full_outer")
    change = F.when(F.col("inb").isNull(), "added").when(F.col("inh").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("h")), "modified")
    return joined.select(key, change.alias("change")).where("change is not null")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def occurrence_index(drifts: DataFrame) -> DataFrame:
    """Each drift's number, from 0, among those of its symbol and obligation, by file and line."""
    w = W.partitionBy("symbol", "obligation").orderBy("file_path", "line", "id")
    return drifts.withColumn("occurrence", F.row_number().over(w) - 1)


def location_invariant(rows: DataFrame) -> DataFrame:
    """File path and line range are all there or all null."""
    whole = F.col("file_path").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    return rows.select(*[F.when(whole, F.col(c)).alias(c) if c in ("file_path", "line_start", "line_end") else F.col(c) for c in rows.columns])


def debounce(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Batches of changes with no pause of ``gap`` inside, and the distinct paths in each."""
    return changes.groupBy(F.session_window("ts", gap).alias("w"), "root").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths")).select("root", F.col("w.start").alias("started"), "n", "n_paths")
