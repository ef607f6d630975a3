"""Snapshots as a stream: new files are checked and flattened as they arrive. An extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_id, fault, module_path, generated_at, modules) of snapshot files, as they come in."""
    text = spark.readStream.schema("value string").option("wholetext", True).text(folder, wholetext=True)
    rows = text.select(F.col("_metadata.file_path").alias("snapshot_id"), "value").withColumn("fault", snapshots.fault("value"))
    graph = F.from_json("value", snapshots.SCHEMA)
    rows = rows.select("snapshot_id", "fault", F.when(F.col("fault").isNull(), graph).alias("graph"))
    return rows.select("snapshot_id", "fault", F.col("graph.provenance.input.modulePath").alias("module_path"), F.try_to_timestamp("graph.provenance.generatedAt").alias("generated_at"), "graph")


def stored_stream(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Append readable snapshots to a table, a project and commit once; runs until what is there is read."""

    def append(batch: DataFrame, _: int) -> None:
        good = batch.where("graph is not null").select("snapshot_id", "module_path", F.coalesce("graph.provenance.input.commitSHA", F.lit("")).alias("commit"), F.to_json("graph").alias("value"))
        snapshots.store(good, table)

    return incoming(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
