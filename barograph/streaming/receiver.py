"""A GPS receiver's state on a stream whose sentences come late or out of order.

What is known of each device is kept between batches in the shared folder: the last value of everything a sentence can
set, the sequence number up to which sentences have been put in order, and the sentences that wait for earlier ones.
Each batch orders what is ready with the operator of the batch table, so that a busy device is cut into buckets and never
one task's, and no row passes through Python.

A sentence waits until its device has sent a clean, supported one that is ``wait`` numbers ahead. One that comes after its
turn is not put in any more: it goes to the table of late ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from barograph.functions.sentences import INITIAL_STATE
from barograph.operators import gps

#: Tables below the stream's folder, with a folder for each batch.
DECODED, HELD, ENDS, STATES, LATE = "decoded", "held", "ends", "states", "late"


def _ends_schema(decoded: T.StructType, columns: list[str]) -> T.StructType:
    timed = [T.StructField("fix_ts", decoded["ts"].dataType)] if "ts" in decoded.names else []
    return T.StructType([decoded["device_id"], T.StructField("upto", T.LongType()), *timed, *[decoded[c] for c in columns]])


def _stored(spark: SparkSession, path: str, table: str, batch: int, schema: T.StructType) -> DataFrame:
    """A batch's part of a table; before the first batch there is nothing."""
    return spark.read.schema(schema).parquet(f"{path}/{table}/batch={batch}") if batch >= 0 else spark.createDataFrame([], schema)


def _store(rows: DataFrame, path: str, table: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch}")


def _with_known(rows: DataFrame, ends: DataFrame, columns: list[str]) -> DataFrame:
    """Sentences and, before each device's, a row that sets what is known of it (``part`` -1)."""
    known = {"seq": F.col("upto"), "part": F.lit(-1), "parsed": F.lit(False)}
    if "ts" in rows.columns:
        known |= {"ts": F.col("fix_ts"), "has_fix": F.col("fix_ts").isNotNull()}
    known |= {c: F.col(c) for c in ["device_id", *columns]}
    return rows.unionByName(ends.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]))


def _states(rows: DataFrame, columns: list[str]) -> DataFrame:
    keep = ["kind", "parsed", *(["ts"] if "ts" in rows.columns else [])]
    return gps.state_of(rows, columns, keep).where("part >= 0")


def advance(rows: DataFrame, batch: int, path: str, columns: list[str], wait: int) -> None:
    """Takes in a batch of decoded sentences. A batch that is repeated replaces what it has written before."""
    spark = rows.sparkSession
    _store(rows, path, DECODED, batch)
    rows = _stored(spark, path, DECODED, batch, rows.schema)
    held = _stored(spark, path, HELD, batch - 1, rows.schema)
    ends = _stored(spark, path, ENDS, batch - 1, _ends_schema(rows.schema, columns))
    # devices as structs, which are never NULL as a whole
    of = F.struct("device_id").alias("of")
    newest = rows.groupBy(of).agg(F.max("seq").alias("newest"))
    marks = ends.select(of, "upto").join(newest, "of", "full").select("of", "upto", F.greatest("upto", F.col("newest") - wait).alias("until"))
    placed = rows.unionByName(held).withColumn("of", of).join(marks, "of")
    late = F.coalesce(F.col("seq") <= F.col("upto"), F.lit(False))
    waits = F.col("seq") > F.col("until")
    _store(placed.where(late).select(*rows.columns), path, LATE, batch)
    _store(placed.where(waits).select(*rows.columns), path, HELD, batch)
    ready = _with_known(placed.where(~late & ~waits).select(*rows.columns), ends, columns)
    _store(_states(ready, columns), path, STATES, batch)
    order = F.struct(*gps.ORDER)
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns}
    if "ts" in rows.columns:
        last = {"fix_ts": F.max_by("ts", F.when(F.col("has_fix"), order)).alias("fix_ts"), **last}
    known = ready.groupBy(of).agg(*last.values())
    # the batch counts once this is there
    _store(marks.join(known, "of", "left").select("of.device_id", F.col("until").alias("upto"), *last), path, ENDS, batch)


def receiver_writer(
    lines: DataFrame, path: str, checkpoint: str, wait: int, hour_offset: int = 0, columns: list[str] | None = None
) -> DataStreamWriter:
    """Keeps the states of a stream of ``(device_id, seq, line[, ts])`` below ``path``; see ``written_states``.

    Sentences are whole within their rows. Of each table but ``states`` and ``late`` only the last batch is needed again;
    older ones are not deleted here.
    """
    columns = columns or list(INITIAL_STATE)
    decoded = gps.decode(lines, hour_offset, columns)
    return decoded.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: advance(rows, batch, path, columns, wait)
    )


def written_states(
    lines: DataFrame, path: str, columns: list[str] | None = None, to_the_end: bool = False
) -> DataFrame:
    """What ``gps.receiver_state`` gives, for all sentences put in order by the last batch that is whole.

    ``to_the_end``: also for those that still wait, as if nothing came before them any more. ``lines`` is the stream, or
    a table like it; only its columns matter. At least one batch must have been written.
    """
    spark, columns = lines.sparkSession, columns or list(INITIAL_STATE)
    decoded = gps.decode(lines, columns=columns).schema
    ends_schema = _ends_schema(decoded, columns)
    batch = spark.read.schema(T.StructType([*ends_schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/{ENDS}").agg(F.max("batch")).first()[0]
    last = -1 if batch is None else batch
    held, ends = _stored(spark, path, HELD, last, decoded), _stored(spark, path, ENDS, last, ends_schema)
    waiting = _states(_with_known(held, ends, columns), columns)
    full = T.StructType([*waiting.schema, T.StructField("batch", T.LongType())])
    states = spark.read.schema(full).parquet(f"{path}/{STATES}").where(F.col("batch") <= last).drop("batch")
    return states.unionByName(waiting) if to_the_end else states


def late_sentences(lines: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Sentences that came after their turn, with the batch that they came in."""
    decoded = gps.decode(lines, columns=columns or list(INITIAL_STATE)).schema
    return lines.sparkSession.read.schema(T.StructType([*decoded, T.StructField("batch", T.LongType())])).parquet(f"{path}/{LATE}")
