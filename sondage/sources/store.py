"""The run store: appended runs, the latest state, diffs and history, as Parquet partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class RunStore:
    """Tables below one folder; any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append_run(self, run: str, findings: DataFrame) -> None:
        """Writes a run's rows to its own partition; writing it again replaces that partition alone."""
        findings.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.root}/runs")

    def run(self, run: str) -> DataFrame:
        return self.runs().where(F.col("run") == run)  # one partition is read

    def runs(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/runs").parquet(f"{self.root}/runs")

    def names(self) -> list[str]:
        """The runs there are, from the partitions' names."""
        return sorted(r.run for r in self.runs().select(F.col("run").cast("string").alias("run")).distinct().collect())

    def write_latest(self, findings: DataFrame) -> None:
        findings.write.mode("overwrite").parquet(f"{self.root}/latest")

    def latest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/latest")

    def history(self) -> DataFrame:
        """One row per run: findings by status and by severity, from columns alone."""
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "resolved")]
        severities = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
        return self.runs().groupBy(F.col("run").cast("string").alias("run")).agg(*counts, *severities)
