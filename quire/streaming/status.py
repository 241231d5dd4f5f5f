"""Resumable runs as a stream: chunk results come in as files, each batch is merged into the status table by chunk name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "name string, seq long, status string, translated string"


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each chunk."""
    return updates.groupBy("name").agg(F.max_by(F.struct("seq", "status", "translated"), "seq").alias("u")).select("name", "u.*")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends every batch's last updates to ``target`` under its batch number, so that a repeated batch replaces itself."""

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(SCHEMA).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The status of every chunk after all batches."""
    return latest(spark.read.parquet(target).drop("batch"))
