"""Structured Streaming over click events (an extension: the reports' A3 as a stream, and carried rotation state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_clicks(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Clicks per day and coupon; state older than the watermark is dropped, later events with it."""
    clicks = events.filter("event_type = 'click'").withColumn("coupon_id", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("bigint"))
    by = clicks.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "coupon_id").agg(F.count("*").alias("clicks"))
    return by.select(F.to_date("window.start").alias("day"), "coupon_id", "clicks")


def distinct_clicks(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Click events once each, within the watermark."""
    return events.filter("event_type = 'click'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
