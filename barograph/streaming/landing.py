"""Keeping the log: every arriving message is appended to a table by day, however late it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def landing_writer(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The checkpoint remembers what has been taken in: a second run adds nothing.

    Nothing is taken out on the way. A message that the source itself delivers twice lands twice;
    ``without_repeats`` takes such repeats out of the landed log.
    """
    return (
        messages.withColumn("day", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def without_repeats(log: DataFrame) -> DataFrame:
    """A landed log with each message once, by its place in the topic; for batch reading, without any limit of time."""
    return log.dropDuplicates(["topic", "partition", "offset"])
