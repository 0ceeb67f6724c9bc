"""Watching the log itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.functions.values import online_text
from barograph.operators.ordered import previous_row

FRESH_SECONDS = 300
SEND_SECONDS = 2.0


def source_freshness(readings: DataFrame, as_of: Column | None = None, threshold: int = FRESH_SECONDS) -> DataFrame:
    """Each source's last message and whether it is still online.

    The moment to judge by defaults to the newest message of all: a one-row subquery over the per-source result.
    """
    seen = readings.groupBy(F.col("picow_local_ip").alias("source_ip")).agg(F.max("read_datetime").alias("last_seen"))
    if as_of is None:
        as_of = seen.agg(F.max("last_seen")).scalar()
    silent = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / F.lit(1e6)
    return seen.select(
        "source_ip", "last_seen", silent.alias("silent_seconds"), online_text(silent <= threshold).alias("status")
    )


def topic_profile(messages: DataFrame) -> DataFrame:
    """Extent and holes of every partition of every topic."""
    return messages.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count("*").alias("messages"),
        (F.max("offset") - F.min("offset") + 1 - F.count("*")).alias("gaps"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def cadence_gaps(
    readings: DataFrame, send_seconds: float = SEND_SECONDS, factor: float = 3.0, bucket_seconds: int = 300
) -> DataFrame:
    """Pauses longer than ``factor`` send intervals between two messages of a source.

    A source that sends as it should leaves 150 messages in a bucket of five minutes.
    """
    rows = readings.select("picow_local_ip", "read_datetime", "kafka_partition", "kafka_offset")
    bucket = F.expr(f"unix_micros(read_datetime) div {bucket_seconds * 1_000_000}")
    pairs = previous_row(
        rows, ["picow_local_ip"], ["read_datetime", "kafka_partition", "kafka_offset"], bucket, ["read_datetime"]
    )
    gap = F.unix_micros("read_datetime") - F.unix_micros("prev_read_datetime")
    return pairs.where(gap > int(send_seconds * factor * 1e6)).select(
        F.col("picow_local_ip").alias("source_ip"),
        F.col("prev_read_datetime").alias("gap_start"),
        F.col("read_datetime").alias("gap_end"),
        (gap / F.lit(1e6)).alias("gap_seconds"),
    )


def top_sources(by_source: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest sources with their place, counted from 1; equal counts go by address."""
    best = [F.desc("messages"), F.asc_nulls_last("source_ip")]
    return by_source.orderBy(*best).limit(k).withColumn("place", F.row_number().over(W.orderBy(*best)))
