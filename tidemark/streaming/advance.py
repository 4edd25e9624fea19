"""Stores that advance as recordings arrive: Structured Streaming with idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import UNSTABLE

RECORDED = "test_id string, item string, flags int, recorded_at timestamp"


def fold_batch(folder: str):
    """Writes a batch under its number: a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("test_id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.bit_or("flags").alias("flags"), F.max("recorded_at").alias("recorded_at")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def start(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold new recordings (RECORDED, Parquet files) into ``folder`` until what is there is read."""
    stream = spark.readStream.schema(RECORDED).parquet(source)
    return stream.writeStream.foreachBatch(fold_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(test_id, items, flags): the latest batch of each test; a test that was ever unstable stays so."""
    rows = spark.read.parquet(folder)
    latest = rows.groupBy("test_id").agg(F.max_by(F.struct("items", "flags"), F.struct("batch", "recorded_at")).alias("r"), F.bit_or(F.col("flags").bitwiseAND(F.lit(UNSTABLE))).alias("ever"))
    return latest.select("test_id", F.col("r.items").alias("items"), F.col("r.flags").bitwiseOR(F.col("ever")).alias("flags"))
