"""Snapshots as a stream: late rows dropped, repeats removed, the latest state upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.normalize import dedupe_last


def snapshot_stream(spark: SparkSession, path: str, schema, time_col: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """New Parquet files as rows; a key repeated within the delay comes through once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], window: str = "5 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows and their distinct state a window; windows close behind the watermark."""
    rows = stream if stream.isStreaming is False else stream.withWatermark(time_col, delay)
    return rows.groupBy(F.window(time_col, window, slide or window), *by).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key under `target`: every batch writes version n + 1 from
    version n, so a batch that is run again gives the same files."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = spark.read.parquet(f"{target}/version={epoch - 1}").unionByName(batch)
        dedupe_last(rows, keys, order).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
