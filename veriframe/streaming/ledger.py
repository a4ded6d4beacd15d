"""Structured Streaming over append-only event ledgers: every operator takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if they are one process and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:/tmp/checkpoints").rstrip("/")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of ``path`` (a glob) as a stream, with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(events: DataFrame, key: str, time: str, ttl: str = "7 days") -> DataFrame:
    """Events without those whose key was seen within ``ttl``; state older than that is dropped."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def latest_values(events: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """Last value by sequence number, so that a late event never overwrites a newer one. One state row per key."""
    return events.groupBy(key).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence), F.count("*").alias("events"))


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), kind, "events")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what is there and returns the stored result. In update mode later rows of a key replace earlier ones
    by the batch they came with (column ``batch``)."""
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")  # a repeated batch writes the same place

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/*")
