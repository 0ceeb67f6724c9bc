"""Late messages of the hourly stream: a ledger tells which hours they belong to, and only these are computed anew.

The hourly stream drops what comes after its watermark has passed the end of the hour. Beside it, ``log_writer`` lands
every message by batch and day, and with each batch a few ledger rows: how many messages of which hour came, and the
newest time among them. What was late follows from the ledger alone, if both streams read batches of the same messages
(the same source with the same limits). ``repair`` computes the hours concerned from their
days of the landed log and switches them in at once; ``repaired_table`` lays them over what the stream wrote.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from barograph.operators.readings import parse_readings
from barograph.operators.rollup import HOURLY_INPUT, hourly_rollup
from barograph.schema import HOUR_KEY, MESSAGES
from barograph.sinks import versions

LATENESS = "2 hours"
REPAIRS, DUE = "repairs", "due"
_LEDGER = "hour timestamp, messages long, newest timestamp, batch long"


def log_writer(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Lands messages and ledger below ``path``; a batch that is repeated replaces its own folders."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/log/batch={batch}")
        landed = rows.sparkSession.read.schema(MESSAGES).parquet(f"{path}/log/batch={batch}")
        hours = landed.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("messages"), F.max("timestamp").alias("newest"))
        hours.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def late_hours(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """hour, late_messages and last_batch of each hour that had ended, ``lateness`` before the newest message of the
    batches so far, when a batch brought more of it. The stream's table may lack these messages, and no others: Spark
    itself compares with the watermark of one batch before and keeps some of them.

    The ledger has a row for each hour that a batch touches: its size doesn't depend on the number of messages.
    """
    ledger = spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    marks = ledger.groupBy("batch").agg(F.max("newest").alias("newest")).select("batch", F.max("newest").over(so_far).alias("before"))
    mark = F.col("before") - F.expr(f"INTERVAL {lateness}")
    late = ledger.join(marks, "batch").where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= mark)
    return late.groupBy("hour").agg(F.sum("messages").alias("late_messages"), F.max("batch").alias("last_batch"))


def _repair_schema(spark: SparkSession) -> T.StructType:
    none = hourly_rollup(parse_readings(spark.createDataFrame([], MESSAGES), HOURLY_INPUT))
    return T.StructType([*none.schema.fields, T.StructField("upto_batch", T.LongType())])


def repairs(spark: SparkSession, path: str) -> DataFrame:
    """The hours computed anew so far, each as its last repair left it, with the batch up to which it counts messages."""
    schema = _repair_schema(spark)
    rows = versions.read(spark, path, versions.current(spark, path), REPAIRS, schema)
    newest = F.max_by(F.struct(*schema.fieldNames()), "upto_batch").alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in HOUR_KEY]).agg(newest).select("row.*")


def repair(spark: SparkSession, path: str, lateness: str = LATENESS, last_skipped_offset: int | None = 2) -> int:
    """Computes the hours anew that late messages came for since they were last computed; gives their number.

    Only the days of these hours are read from the log. The days' names come to the driver.
    """
    start = F.make_timestamp(*(F.col(k).cast("int") for k in HOUR_KEY), F.lit(0), F.lit(0))
    old, schema = versions.current(spark, path), T.StructType.fromDDL("hour timestamp, last_batch long, day date")
    # an hour whose late messages are all rejects has no row to show for it: so done is what was due
    done = versions.read(spark, path, old, DUE, schema).groupBy("hour").agg(F.max("last_batch").alias("upto_batch"))
    due = late_hours(spark, path, lateness).join(done, "hour", "left")
    due = due.where(F.col("upto_batch").isNull() | (F.col("upto_batch") < F.col("last_batch"))).select("hour", "last_batch")
    run = uuid4().hex
    listed = versions.stage(due.withColumn("day", F.to_date("hour")), path, DUE, "day", run)
    if not listed:
        return 0
    due = versions.read(spark, path, versions.Version(0, tuple(listed)), DUE, schema)
    days = sorted({f.part for f in listed})
    log = spark.read.schema(T.StructType([*MESSAGES.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])).parquet(f"{path}/log")
    log = log.where(F.col("day").isin(*[F.lit(d).cast("date") for d in days])).dropDuplicates(["topic", "partition", "offset"])
    log = log.join(due.select("hour"), F.date_trunc("hour", "timestamp") == F.col("hour"), "left_semi").select(*MESSAGES.fieldNames())
    fresh = hourly_rollup(parse_readings(log, HOURLY_INPUT, last_skipped_offset))
    fresh = fresh.join(due.select(F.col("hour").alias("_hour"), F.col("last_batch").alias("upto_batch")), start == F.col("_hour")).drop("_hour")
    folders = versions.stage(fresh.select(*_repair_schema(spark).fieldNames()), path, REPAIRS, "date", run)
    versions.switch(spark, path, old.with_folders([*listed, *folders]))
    return due.count()


def repaired_table(spark: SparkSession, path: str, streamed: DataFrame) -> DataFrame:
    """The stream's table with the repaired hours in place of its own, and ``status``: streamed or repaired.

    The stream never returns to an hour that its watermark has passed, so a repair is never older than the stream's row.
    """
    fixed = repairs(spark, path).select(*streamed.columns, F.lit("repaired").alias("status"))
    kept = streamed.join(fixed.select(*HOUR_KEY), HOUR_KEY, "left_anti").select(*streamed.columns)
    return kept.withColumn("status", F.lit("streamed")).unionByName(fixed)
