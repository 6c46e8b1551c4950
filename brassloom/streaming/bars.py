"""Streaming bars: an extension beyond the batch operators, for events that keep coming.

Events are grouped into tumbling windows by event time; the watermark bounds the state to windows that can still
change, and late events beyond it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(events: DataFrame, every: str = "1 day", late: str = "1 hour", ts: str = "ts", asset: str = "event_type", value: str = "value", order: str = "event_id") -> DataFrame:
    """date, asset, open, high, low, close and volume of each window; works on a stream and on a batch alike."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    first = F.struct(ts, order)
    return timed.groupBy(F.window(ts, every).alias("w"), F.col(asset).alias("asset")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, first).alias("close"), F.count("*").alias("volume")
    ).select(F.col("w.start").alias("start"), "asset", "open", "high", "low", "close", "volume")


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, **how) -> DataFrame:
    """Read the Parquet files under source as a stream, write the bars that are final as Parquet, and give them back."""
    schema = spark.read.parquet(source).schema
    given = spark.readStream.schema(schema).parquet(source)
    given = given.withColumn("ts", F.col("ts").cast("timestamp"))
    query = bars(given, **how).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
