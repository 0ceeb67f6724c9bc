"""Comparing a stored hourly table with a fresh one, and bringing it up to date without losing old hours."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.schema import HOUR_KEY, HOURLY_COLUMNS

VALUES = [c for c in HOURLY_COLUMNS if c not in HOUR_KEY]


def mart_match(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Hours whose newest message time is the same in both tables, with both message counts."""
    s = stored.select("datetime", F.col("count").alias("stored_count"))
    f = fresh.select("datetime", *HOUR_KEY, F.col("count").alias("fresh_count"))
    return s.join(f, "datetime")


def _paired(stored: DataFrame, fresh: DataFrame, complete_from: Column | None) -> DataFrame:
    """Each hour of either table with its values in both; a fresh hour that may be cut off gives way to a stored one."""
    s = stored.select(*HOUR_KEY, F.struct(*VALUES).alias("stored"))
    f = fresh.select(*HOUR_KEY, F.struct(*VALUES).alias("fresh"))
    both = s.join(f, HOUR_KEY, "full")
    if complete_from is None:
        return both
    start = F.make_timestamp(*(F.col(k).cast("int") for k in HOUR_KEY), F.lit(0), F.lit(0))
    whole = F.col("stored").isNull() | (start >= complete_from)
    return both.withColumn("fresh", F.when(whole, F.col("fresh")))


def mart_diff(stored: DataFrame, fresh: DataFrame, complete_from: Column | None = None) -> DataFrame:
    """Every hour of either table: ``inserted``, ``changed``, ``same``, or ``stale`` if only the stored table has it whole.

    complete_from: the time from which ``fresh`` has every message; None if it lacks none at all.
    """
    equal = reduce(and_, [F.col(f"stored.{c}").eqNullSafe(F.col(f"fresh.{c}")) for c in VALUES])
    status = (
        F.when(F.col("stored").isNull(), "inserted")
        .when(F.col("fresh").isNull(), "stale")
        .when(equal, "same")
        .otherwise("changed")
    )
    return _paired(stored, fresh, complete_from).select(
        *HOUR_KEY,
        status.alias("status"),
        F.col("stored.count").alias("stored_count"),
        F.col("fresh.count").alias("fresh_count"),
    )


def mart_upsert(stored: DataFrame, fresh: DataFrame, complete_from: Column | None = None) -> DataFrame:
    """The stored table brought up to date: fresh hours, and stored ones where ``fresh`` has none or only part of one.

    complete_from: the time from which ``fresh`` has every message, such as the start of what a log still holds. An
    hour that begins earlier may be cut off in ``fresh`` and never replaces a stored one. None: ``fresh`` lacks nothing.
    """
    row = _paired(stored, fresh, complete_from).select(*HOUR_KEY, F.coalesce("fresh", "stored").alias("row"))
    return row.select(*(F.col(c) if c in HOUR_KEY else F.col(f"row.{c}").alias(c) for c in fresh.columns))
