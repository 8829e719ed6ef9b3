"""Streams: repeated imports become one, and activity is counted in event-time windows. (Additions; batch code has no streams to match.)"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(offers: DataFrame, time: str = "collected_at", key: str = "fingerprint", late: str = "7 days") -> DataFrame:
    """Each fingerprint once; state older than the watermark is dropped."""
    return offers.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), by, "n")


def import_stream(spark: SparkSession, folder: str, schema: str, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `take` on each batch of new, not yet seen offers of a folder of Parquet files, until all present files are read."""
    offers = once(spark.readStream.schema(schema).parquet(folder))
    return offers.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
