"""Incremental recompute: scans of changed files come as a stream, and the state of findings follows.

A scan tells all that is found in one file at one version. What is kept of
scans is a set (file, scan, rule), so a batch that comes twice adds nothing and
one that comes late falls into its place. A batch recomputes the findings of
its own files alone, from their scans; those of other files aren't read. Both
sets are keyed snapshots: each batch writes what it changes as one commit, and
after some batches the changes are written together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sondage.operators.graph import kept
from sondage.sources.snapshots import SnapshotStore

REPO = "state"


def lifecycle_of(scans: DataFrame) -> DataFrame:
    """(file_path, rule_key, status, first_seen, last_seen, resolved_at): what all scans of each file say together.

    scans: file_path, scan (a number that grows), rule_key, null or '' where a
    scan found nothing. A rule's finding is active if the file's last scan has
    it; it was first seen in the scan after the last one without it. A resolved
    one tells its last stretch, and the scan that missed it. Repeated rows count
    once; scans without a path drop out.
    """
    rows = scans.where("file_path is not null and scan is not null").select("file_path", "scan", F.coalesce("rule_key", F.lit("")).alias("rule_key")).distinct()
    of_file = W.partitionBy("file_path")
    placed = rows.withColumn("k", F.dense_rank().over(of_file.orderBy("scan"))).withColumn("last", F.max("k").over(of_file))
    # the scan after each, which a finding that ends there was missed by
    next_ = placed.select("file_path", "k", "scan").distinct().withColumn("missed", F.lead("scan").over(of_file.orderBy("k"))).drop("scan")
    islands = placed.where("rule_key <> ''").withColumn("island", F.col("k") - F.row_number().over(W.partitionBy("file_path", "rule_key").orderBy("k")))
    stretches = islands.groupBy("file_path", "rule_key", "island").agg(F.min("scan").alias("first_seen"), F.max("scan").alias("last_seen"), F.max("k").alias("k"), F.first("last").alias("last"))
    newest = stretches.groupBy("file_path", "rule_key").agg(F.max_by(F.struct("first_seen", "last_seen", "k", "last"), "k").alias("s")).select("file_path", "rule_key", "s.*")
    status = F.when(F.col("k") == F.col("last"), "active").otherwise("resolved")
    return newest.join(next_, ["file_path", "k"]).select("file_path", "rule_key", status.alias("status"), "first_seen", "last_seen", F.when(F.col("k") < F.col("last"), F.col("missed")).alias("resolved_at"))


class FindingsState:
    """The findings that a stream of scans leaves, below ``root``; ``compact_every`` batches the changes are written together."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 20):
        self.scans = SnapshotStore(spark, root, "scans", ["file_path", "scan", "rule_key"])
        self.findings = SnapshotStore(spark, root, "findings", ["file_path", "rule_key"])
        self.compact_every = compact_every

    def update(self, batch: DataFrame, number: int) -> None:
        """Takes a batch (file_path, scan, rule_key) in; the same number again, or rows that were there, change nothing more."""
        at, commit = f"{number:020}", f"b{number}"
        rows = kept(batch.where("file_path is not null and scan is not null").select("file_path", "scan", F.coalesce("rule_key", F.lit("")).alias("rule_key")).distinct())
        self.scans.write_changes(REPO, commit, at, rows, rows.limit(0))
        files = rows.select("file_path").distinct()
        now = lifecycle_of(self.scans.read(REPO).join(files, "file_path", "left_semi"))
        self.findings.write_changes(REPO, commit, at, now, now.limit(0))  # scans only grow, so no finding's key goes
        if (number + 1) % self.compact_every == 0:
            self.scans.compact(REPO)
            self.findings.compact(REPO)

    def current(self) -> DataFrame:
        return self.findings.read(REPO)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Runs ``update`` on each micro-batch of a stream of scans, up to what is there now."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.update(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
