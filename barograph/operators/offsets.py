"""Which offsets of a log were read, which are still to be read, and which are missing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.operators.ordered import previous_row

PLACE = ["topic", "partition"]
#: The ledger: a row for each run and partition, with the first and last offset that the run took.
EXTENT = "topic string, partition int, first_offset long, last_offset long, messages long"
#: Offsets per bucket when a partition is walked in order.
BUCKET = 65_536


def extent(messages: DataFrame) -> DataFrame:
    """From where to where a run reads each partition."""
    return messages.groupBy(*PLACE).agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("messages")
    )


def intervals(ledger: DataFrame) -> DataFrame:
    """What the runs have read together: ``ranges`` of each partition, those that overlap or touch put together.

    The ledger has one row for each run and partition.
    """
    order = W.partitionBy(*PLACE).orderBy("first_offset", "last_offset")
    reached = F.max("last_offset").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("first_offset") > reached + 1), 1).otherwise(0)
    islands = ledger.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    merged = islands.groupBy(*PLACE, "island").agg(F.min("first_offset").alias("first"), F.max("last_offset").alias("last"))
    return merged.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def unread(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages that no run of the ledger has read."""
    seen = intervals(ledger).select(F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), "ranges")
    same = (F.col("topic") == F.col("_topic")) & (F.col("partition") == F.col("_partition"))
    within = F.exists("ranges", lambda r: (F.col("offset") >= r["first"]) & (F.col("offset") <= r["last"]))
    return messages.join(seen, same, "left").where(~F.coalesce(within, F.lit(False))).select(*messages.columns)


def within(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Messages within a run's extent: what came since it was measured is left to the next run."""
    b = bounds.select(F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("last_offset").alias("_last"))
    same = (F.col("topic") == F.col("_topic")) & (F.col("partition") == F.col("_partition")) & (F.col("offset") <= F.col("_last"))
    return messages.join(b, same, "left_semi")


def starting_offsets(ledger: DataFrame) -> str | None:
    """Where a topic's next scan begins, as its reader wants it; one row per partition comes to the driver."""
    rows = ledger.groupBy(*PLACE).agg(F.max("last_offset").alias("last")).collect()
    topics: dict[str, dict[str, int]] = {}
    for r in sorted(rows):
        topics.setdefault(r["topic"], {})[str(r["partition"])] = r["last"] + 1
    return json.dumps(topics) if topics else None


def missing(messages: DataFrame) -> DataFrame:
    """Stretches of offsets that a partition lacks between its first and its last one.

    Offsets are compared with the one before, in buckets of a partition: no partition is walked by one task. Repeats
    are no gaps.
    """
    rows = messages.select(*PLACE, "offset").distinct()
    pairs = previous_row(rows, PLACE, ["offset"], F.expr(f"offset div {BUCKET}"), ["offset"])
    gap = pairs.where(F.col("offset") - F.col("prev_offset") > 1)
    first, last = F.col("prev_offset") + 1, F.col("offset") - 1
    return gap.select(*PLACE, first.alias("first_missing"), last.alias("last_missing"), (last - first + 1).alias("missing"))
