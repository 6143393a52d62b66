"""Structured Streaming forms of keyed state: idempotent upserts by micro-batch, deduplication and stale claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.upsert import titles


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(events: DataFrame, target: str, checkpoint: str, key: str, seq: str, attributes: Sequence[str], at: str) -> StreamingQuery:
    """Appends each micro-batch's upserts as one version folder; a batch that runs again overwrites its own version, so counts
    do not double. `upserted` merges the versions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state = titles(batch, key, seq, attributes, at).join(batch.groupBy(key).agg(F.max(seq).alias(seq)), key)
        state.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, target: str, key: str, seq: str, attributes: Sequence[str]) -> DataFrame:
    """Current rows from all versions."""
    versions = spark.read.parquet(target)
    out = versions.groupBy(key).agg(F.max_by(F.struct(*attributes), seq).alias("row"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))
    return out.select(key, "row.*", "first_seen", "last_seen", "seen_count")


def deduplicated_stream(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark: state is bounded by the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def requeued(queue: DataFrame, status: str, updated: str, now: str, minutes: int, attempts: str, max_attempts: int) -> DataFrame:
    """Errors with attempts left, and claims older than the limit, are pending again."""
    stale = (F.col(status) == "processing") & (F.col(updated) < F.to_timestamp(F.lit(now)) - F.make_dt_interval(mins=F.lit(minutes)))
    retry = (F.col(status) == "error") & (F.col(attempts) < max_attempts)
    return queue.withColumn(status, F.when(stale | retry, "pending").otherwise(F.col(status)))
