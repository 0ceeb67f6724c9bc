"""Publishing payloads and showing streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def document_bytes(document: Column) -> Column:
    """A struct column written as the JSON bytes of a message; the inverse of the parse."""
    return F.to_json(document).cast("binary")


def payload_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Key-less records as Kafka's writer wants them."""
    return df.select(F.lit(None).cast("binary").alias("key"), F.col(value).cast("binary").alias("value"))


def publish(df: DataFrame, servers: str, topic: str) -> None:
    """Append payloads to a topic; needs Spark's Kafka connector on the class path."""
    payload_rows(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_stream(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        payload_rows(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def console(df: DataFrame, rows: int = 10) -> DataStreamWriter:
    return df.writeStream.format("console").option("truncate", False).option("numRows", rows)


def counted(df: DataFrame, name: str, measure: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame with a row count taken while it is written, instead of a count job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias(measure)), seen
