"""Raw readings calibrated as they arrive, with the constants that are stored at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from barograph.functions.compensation import CALIBRATION
from barograph.operators.calibration import calibrate, unpack_readings

CONSTANTS = T.StructType([T.StructField("device_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in CALIBRATION]])


def calibrated_writer(bursts: DataFrame, constants: str, path: str, checkpoint: str, t2_preshift: bool = True) -> DataStreamWriter:
    """Calibrates each batch below ``path`` with what the folder ``constants`` holds when the batch begins.

    A join of a stream with a table that was read when the stream was started would go on with the constants of that
    time. Readings of devices without constants are left out, as in a batch run. A batch that is repeated replaces its own folder.
    """

    def write(rows: DataFrame, batch: int) -> None:
        now = rows.sparkSession.read.schema(CONSTANTS).parquet(constants)
        calibrate(unpack_readings(rows), now, t2_preshift).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return bursts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
