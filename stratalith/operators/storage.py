"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own under ``spark.checkpoint.dir``. Only where driver and executors are one process (tests)
    may the setting be missing; a local folder is taken then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: its rows are the same in every later use, and a lost
    executor costs only its running tasks."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to all partitions that are set. Adaptive execution joins partitions by their packed bytes, however many rows
    those are; what is dealt by number stays apart."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def globally_ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``rank`` (from 1) in a total order, without a single sorted partition: ranges are sorted by themselves,
    and each one's first rank is the running sum of the ranges' sizes (a row per range)."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(ranges.withColumn("__range", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = placed.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__r", before.alias("__before"))
    joined = placed.join(F.broadcast(starts), F.col("__range") == F.col("__r"))  # as many rows as shuffle partitions
    return joined.withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__place", "__range", "__r", "__before")
