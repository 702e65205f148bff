"""Windows over event tables, the same for batches and streams, and incremental runs by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hourly(events: DataFrame) -> DataFrame:
    """event_type, start of the hour, events, distinct users. Exact distinct counts need a batch."""
    return events.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("start")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event_type in tumbling or sliding windows; rows later than ``late`` may be left out by a stream."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", length, slide or length), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start and number of events of each session."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def table_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_into(stream: DataFrame, table: str, checkpoint: str, apply) -> None:
    """Pass all that is there, micro-batch by micro-batch, to ``apply(rows, path of the table)``; restarts go on from the
    checkpoint."""
    writer = stream.writeStream.foreachBatch(lambda rows, _: apply(rows, table)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
