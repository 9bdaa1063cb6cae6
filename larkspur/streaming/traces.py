"""Extension beside the batch operators: traces as a stream, their latency in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_latency(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and maximum of each route and window; rows later than the watermark are dropped by the engine."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("window.start", "event_type", "n", "mean", "most")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, once each, until the input is used up."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
