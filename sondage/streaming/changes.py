"""Change feeds: batches of changed files, as a stream over a folder of change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def change_stream(spark: SparkSession, folder: str, schema: str = "root string, path string, ts timestamp", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Changes of a root without a pause of ``gap``, closed once the watermark has passed them.

    State is one session per root and gap; the watermark bounds it.
    """
    return (
        changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "root")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("path").alias("n_paths")).select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "n_paths")
    )


def rescan(changes: DataFrame, analyse, sink: str, checkpoint: str):
    """Runs ``analyse`` on the distinct paths of every micro-batch and appends what it finds; each batch once."""

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch.select("path").distinct()).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
