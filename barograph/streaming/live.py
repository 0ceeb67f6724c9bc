"""The live page as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from barograph.operators.live import event_lines, live_projection

PACE = "1 second"


def without_repeats(messages: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each message once, by its place in the topic, if its repeats come ``within`` that time of event time.

    The places of that time are the state. A message that comes later than that is dropped here; the landed log has it.
    """
    return messages.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["topic", "partition", "offset"])


def live_writer(messages: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> DataStreamWriter:
    """Stateless: each message becomes one flat row as it arrives."""
    rows = live_projection(messages)
    return rows.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def line_writer(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same as the text lines that the page receives."""
    rows = event_lines(live_projection(messages))
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    )


def paced(writer: DataStreamWriter, every: str = PACE) -> DataStreamWriter:
    """A batch per interval; unlike a pause per message this cannot fall behind the senders."""
    return writer.trigger(processingTime=every)
