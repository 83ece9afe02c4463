"""Event streams: tumbling windows, sessions and idempotent ingestion, the same over batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, directory: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the event files in a directory."""
    schema = spark.read.parquet(f"{directory}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(directory)


def timed(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as a time with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and event type; in a stream, events later than ``late`` are dropped."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events no further apart than ``gap``."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once; in a stream, repetitions within the watermark."""
    e = timed(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; a second run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
