"""Messages to typed readings, and the messages that give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.functions.values import strip_unit
from barograph.schema import DOCUMENT, DOCUMENT_PATHS, MEASURE, document_schema

READING_COLUMNS = [
    "kafka_offset",
    "kafka_partition",
    "kafka_datetime",
    "kafka_topic",
    "id",
    "bme280_pressure",
    "bme280_temperature",
    "bme280_humidity",
    "device_datetime",
    "read_datetime",
    "read_date",
    "picow_local_ip",
    "picow_temperature",
    "picow_mem_alloc_bytes",
    "picow_mem_free_bytes",
    "picow_cpu_freq_mhz",
    "picow_free_storage_kb",
    "spark_process_datetime",
]

#: How each document value becomes a column; the device writes its clock without leading zeros.
_UNITS = {"bme280_pressure": "hPa", "bme280_temperature": "C", "bme280_humidity": "%"}
_DEVICE_CLOCK = "yyyy-M-d H:m:s"


def skip_warm_up(messages: DataFrame, last_skipped_offset: int | None = 2) -> DataFrame:
    """The first messages of every partition are test messages and are left out."""
    return messages if last_skipped_offset is None else messages.where(F.col("offset") > last_skipped_offset)


def parse_documents(messages: DataFrame, schema: T.StructType = DOCUMENT) -> DataFrame:
    """The envelope plus the document's top fields.

    The document is parsed once per message, also where a parsed field is filtered on later
    (see ``computed_once``; here the struct is the document itself).
    """
    return messages.select(
        "topic",
        "partition",
        "offset",
        "timestamp",
        "value",
        F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))),
    )


def _document_value(name: str) -> Column:
    raw = F.col(".".join(DOCUMENT_PATHS[name]))
    if name in _UNITS:
        return strip_unit(raw, _UNITS[name])
    if name == "device_datetime":
        return F.try_to_timestamp(raw, F.lit(_DEVICE_CLOCK))
    if name == "picow_temperature":
        return raw.try_cast(MEASURE)
    return raw


def parse_readings(
    messages: DataFrame, columns: list[str] | None = None, last_skipped_offset: int | None = 2, broker_zone: str = "UTC"
) -> DataFrame:
    """Messages with an integer id, flat and typed; ``columns`` narrows both the result and the JSON parse.

    Event time is the broker's clock. The device's own clock is kept in ``device_datetime``.
    """
    columns = columns or READING_COLUMNS
    docs = parse_documents(skip_warm_up(messages, last_skipped_offset), document_schema(columns)).where(
        F.col("id").isNotNull()
    )
    broker_time = F.col("timestamp") if broker_zone == "UTC" else F.to_utc_timestamp("timestamp", broker_zone)
    known = {
        "kafka_offset": F.col("offset").cast("bigint"),
        "kafka_partition": F.col("partition"),
        "kafka_datetime": broker_time,
        "kafka_topic": F.col("topic"),
        "id": F.col("id"),
        "read_datetime": broker_time,
        "read_date": F.to_date(broker_time),
        "spark_process_datetime": F.current_timestamp(),
    }
    return docs.select(*[(known[c] if c in known else _document_value(c)).alias(c) for c in columns])


def rejects(messages: DataFrame, last_skipped_offset: int | None = 2) -> DataFrame:
    """The other messages, with the reason: ``readings`` and ``rejects`` together are all messages."""
    text = F.col("value").cast("string")
    warm_up = F.lit(False) if last_skipped_offset is None else F.col("offset") <= last_skipped_offset
    return (
        parse_documents(messages, document_schema([]))
        .where(F.col("id").isNull() | warm_up)
        .select(
            "topic",
            "partition",
            "offset",
            "timestamp",
            "value",
            F.when(warm_up, "warm_up")
            .when(F.get_json_object(text, "$").isNull(), "malformed_json")
            .when(F.get_json_object(text, "$.id").isNotNull(), "bad_number")
            .otherwise("missing_id")
            .alias("reason"),
        )
    )


def reject_report(messages: DataFrame, last_skipped_offset: int | None = 2) -> DataFrame:
    return rejects(messages, last_skipped_offset).groupBy("reason").agg(
        F.count("*").alias("messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


def payload_versions(messages: DataFrame, last_skipped_offset: int | None = 2) -> DataFrame:
    """How many messages come in each document shape.

    v1 has no id, v2 writes units behind the sensor values, v3 writes plain numbers, bad is no JSON.
    """
    docs = parse_documents(skip_warm_up(messages, last_skipped_offset), document_schema(["bme280_temperature"]))
    has_id, sensor, text = F.col("id").isNotNull(), F.col("bme280.temperature"), F.col("value").cast("string")
    # only messages without a usable id are looked at a second time
    version = (
        F.when(has_id & sensor.endswith("C"), "v2")
        .when(has_id & sensor.try_cast("double").isNotNull(), "v3")
        .when(has_id, "other")
        .when(F.get_json_object(text, "$").isNull(), "bad")
        .when(F.get_json_object(text, "$.id").isNull(), "v1")
        .otherwise("other")
    )
    return docs.groupBy(version.alias("version")).agg(F.count("*").alias("messages"))


def before_date(readings: DataFrame, day: str) -> DataFrame:
    return readings.where(F.col("read_date") < F.lit(day).cast("date"))


def clock_skew(readings: DataFrame) -> DataFrame:
    """Per source: how far the broker's clock is ahead of the device's, in microseconds."""
    skew = F.unix_micros("read_datetime") - F.unix_micros("device_datetime")
    return readings.groupBy(F.col("picow_local_ip").alias("source_ip")).agg(
        F.count("device_datetime").alias("messages"),
        F.min(skew).alias("min_skew_us"),
        F.max(skew).alias("max_skew_us"),
    )
