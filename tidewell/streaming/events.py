"""Streams over an event table: rate windows, duplicates within a time to live, sessions.

Each reads with `readStream` and runs what is there (`availableNow`) with a watermark, so a job can be started again on
its checkpoint and goes on where it was. Results are written as Parquet by the stream and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream, its time as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, key: str, limit: int, every: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Windows in which a key has more events than the limit."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col(key)).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("w.start").alias("window_start"), key, "n")


def first_seen(events: DataFrame, key: list[str], ttl: str = "40 days") -> DataFrame:
    """The first event of each key within its time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Runs of a key's events without a longer gap, with their count and sum."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("session_start"), key, "n", "total")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream makes of the rows that are there, ended and read back; closed by the watermark's last advance."""
    spark = stream.sparkSession
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
