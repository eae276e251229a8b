"""The trend of active findings, replayed for every run in one sweep.

A finding is active from the event that adds it to the one that resolves it or
changes its severity; the two are +1 and -1 on their runs. The totals of a run
are the running sums of these changes over all runs before, so however many
points the trend has, events are exchanged once, by finding, and what follows
is as small as runs times severities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sondage.operators.findings import enabled
from sondage.operators.graph import kept

#: Severities, each a column of the trend.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def changes(log: DataFrame) -> DataFrame:
    """(run, severity, delta): what each run changes in the number of active findings of a severity.

    log: id, run, op (added or resolved), severity. Within a run an addition
    follows a resolution; of several additions in a run the greatest severity by
    name counts; a resolution of what isn't active, and an addition of what is
    active with that severity, change nothing.
    """
    last = log.groupBy("id", "run").agg(F.max(F.when(F.col("op") == "added", F.struct(F.lit(1).alias("on"), F.col("severity").alias("severity"))).otherwise(F.struct(F.lit(0).alias("on"), F.lit(None).cast("string").alias("severity")))).alias("now"))
    before = F.lag("now").over(W.partitionBy("id").orderBy("run"))
    moved = last.withColumn("was", before).withColumn("a", F.when(F.col("was.on") == 1, F.col("was.severity"))).withColumn("b", F.when(F.col("now.on") == 1, F.col("now.severity")))
    step = F.explode(F.array(F.struct(F.col("a").alias("severity"), F.lit(-1).alias("delta")), F.struct(F.col("b").alias("severity"), F.lit(1).alias("delta")))).alias("x")
    return moved.where(~F.col("a").eqNullSafe(F.col("b"))).select("run", step).select("run", "x.*").where("severity is not null").groupBy("run", "severity").agg(F.sum("delta").alias("delta"))


def running_sums(rows: DataFrame, order: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """``rows``, one per value of ``order``, with the sums of ``columns`` over all rows up to each.

    Ranges of the order are summed side by side; what the ranges before hold,
    a row per range, is added to each.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()))
    within = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    carried = dealt.groupBy("__p").agg(*[F.sum(c).alias(c) for c in columns]).select("__p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    summed = dealt.select(*[c for c in dealt.columns if c not in columns], *[F.sum(c).over(within).alias(c) for c in columns])
    return summed.join(F.broadcast(carried), "__p").select(*[(F.col(c) + F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def replayed(log: DataFrame, runs: DataFrame, disabled: DataFrame) -> DataFrame:
    """A row per run: its active findings by severity, ``total``, ``new``, ``unchanged`` and ``resolved``.

    log: as above, with rule_key; findings of disabled rules (rule_key) don't
    count. ``new`` and ``resolved`` are the findings that the run's own events
    add and resolve; ``unchanged`` is the rest of the total. Runs without events
    carry on what was before; a run that isn't in ``runs`` (run) has no row but
    its events count; no runs give no rows.
    """
    live = enabled(log, disabled)
    wide = changes(live).groupBy("run").pivot("severity", list(SEVERITIES)).agg(F.sum("delta"))
    own = live.groupBy("run").agg(F.count_distinct(F.when(F.col("op") == "added", F.col("id"))).alias("new"), F.count_distinct(F.when(F.col("op") == "resolved", F.col("id"))).alias("resolved"))
    asked = runs.select("run").distinct().withColumn("asked", F.lit(True))
    steps = asked.join(wide, "run", "full").join(own, "run", "left").fillna(0, [*SEVERITIES, "new", "resolved"])
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    out = running_sums(steps, "run", list(SEVERITIES)).where("asked").withColumn("total", total)
    return out.select("run", *SEVERITIES, "total", "new", F.greatest(F.lit(0), F.col("total") - F.col("new")).alias("unchanged"), "resolved")
