"""What each batch of a stream took in and gave out, stored as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from barograph.operators.readings import READING_COLUMNS, parse_readings, rejects

COUNTS = "messages long, readings long, rejects long, first_time timestamp, last_time timestamp, batch long"


def counted_writer(messages: DataFrame, path: str, checkpoint: str, last_skipped_offset: int | None = 2) -> DataStreamWriter:
    """Lands readings and rejects by batch, and with each batch a row of counts in ``path/counts``.

    The counts are of what was written, read from the files' footers, so a batch that is repeated replaces its row.
    Messages = readings + rejects in every row, or something got lost.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = f"{path}/messages/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        taken = spark.read.schema(rows.schema).parquet(at)
        parts = {"readings": parse_readings(taken, READING_COLUMNS, last_skipped_offset), "rejects": rejects(taken, last_skipped_offset)}
        counts: list[Column] = [taken.agg(F.count("*")).scalar().alias("messages")]
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            written = spark.read.schema(part.schema).parquet(f"{path}/{name}/batch={batch}")
            counts.append(written.agg(F.count("*")).scalar().alias(name))
        counts += [taken.agg(f("timestamp")).scalar().alias(n) for n, f in (("first_time", F.min), ("last_time", F.max))]
        spark.range(1).select(*counts).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
