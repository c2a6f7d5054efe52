"""Streaming ingest: resumable file harvest, upsert per micro-batch, event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.tables import Table


def file_stream(spark: SparkSession, path: str, like: DataFrame, max_files: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``; the checkpoint remembers the files that are done."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and key of an event-time stream (or table); rows later than the watermark are dropped from a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull())
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    return e.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n_rows", "total")


def run_upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str], version: str) -> None:
    """Works off what is there now, upserting each micro-batch into the table ``target``. A batch that runs twice changes nothing.

    A target that can't be read stops the stream; only one that was never written counts as empty.
    """

    def one(batch: DataFrame, _: int) -> None:
        Table(batch.sparkSession, target, keys).upsert(batch, version)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_new_keys(stream: DataFrame, out: str, checkpoint: str, key: str, ts: str, late: str = "3650 days") -> None:
    """Appends the first row of every key; keys are remembered as long as the watermark allows."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(key).isNotNull()).withWatermark(ts, late)
    q = s.dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
