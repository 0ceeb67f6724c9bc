"""Reading the message log. Every source gives the same envelope, ``barograph.schema.MESSAGES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barograph.schema import MESSAGES
from barograph.session import pin_utc


def kafka_options(
    servers: str,
    topic: str,
    starting: str | None = None,
    ending: str | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Options of a topic scan. A batch scan runs from earliest to latest unless offsets are given.

    Pinning ``ending`` once per run keeps several result tables on the same snapshot. ``min_partitions`` splits a
    topic of few partitions by ranges of offsets, without a shuffle.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if starting:
        options["startingOffsets"] = starting
    if ending:
        options["endingOffsets"] = ending
    return options


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting: str | None = None,
    ending: str | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """Batch scan of a topic; needs Spark's Kafka connector on the class path."""
    options = kafka_options(servers, topic, starting, ending, min_partitions)
    reader = pin_utc(spark).read.format("kafka").options(**options)
    return reader.load().select(*MESSAGES.fieldNames())


def stream_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Tail of a topic, from its end unless told otherwise."""
    reader = pin_utc(spark).readStream.format("kafka").options(**kafka_options(servers, topic, starting))
    return reader.load().select(*MESSAGES.fieldNames())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A landed log: Parquet with the envelope's columns."""
    return pin_utc(spark).read.schema(MESSAGES).parquet(path).select(*MESSAGES.fieldNames())


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = pin_utc(spark).readStream.schema(MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
